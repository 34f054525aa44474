"""Command line.

    python -m duolex list                        the commands and queries
    python -m duolex query NAME DIR [OUT]        one query: its first rows, or Parquet
    python -m duolex sql NAME                    the SQL that it is checked against
    python -m duolex COMMAND DIR [OUT]           the queries of a command, each as a table in OUT
    python -m duolex validate DIR [--strict]     violations by rule; with --strict 1 is returned if there are any
"""

import sys

from .functions.session import session
from .plans import corpus_queries, entity_queries, relational_queries, rule_queries, scalar_queries, scope_queries, text_queries, vector_queries  # noqa: F401
from .plans.registry import QUERIES, SQL

#: The queries that a command runs.
COMMANDS = {
    "registry": ("race_registry", "race_unresolved", "race_cycles"),
    "audit": ("candidate_support", "audit_group_years", "audit_gates", "audit_gaps"),
    "queue": ("discovery_queue", "document_jobs", "attempts_ledger", "staged_retries", "extraction_batch"),
    "context": ("context_inventory",),
    "rosters": ("presidential_rosters", "roster_winners"),
    "segments": ("paragraphs", "sentences", "segments_packed", "boilerplate_flags"),
    "analyze": ("mpif", "group_tfidf", "feature_prevalence", "hot_cold_terms", "lexical_tables"),
    "topics": ("nearest_topic", "keyword_topics", "topic_emphasis"),
    "kde": ("density_ratio", "density_zones", "kde_grid", "kmeans_regions", "projection_trust"),
    "points": ("sticking_points", "sticking_point_topics", "sticking_point_cycles", "shared_mentions", "affirmative_mentions"),
    "evidence": ("inferred_fields", "scoped_documents", "entries_under_headings", "similar_names", "name_matches"),
    "narratives": ("neighbour_graph", "nearest_of_queries", "knn_mutual", "dp_means", "narrative_lift"),
    "duplicates": ("exact_dupes", "near_dupes", "streamed_duplicates"),
    "addresses": ("url_canonical", "url_class", "historical_urls", "discovery_urls", "candidate_domains"),
    "report": ("canonical_report", "gates"),
}


def main(args: list[str]) -> int:
    if len(args) > 1 and args[0] == "sql" and args[1] in SQL:
        print(SQL[args[1]])
        return 0
    if len(args) > 2 and args[0] == "query" and args[1] in QUERIES:
        made = QUERIES[args[1]](session("duolex"), args[2])
        made.write.mode("overwrite").parquet(args[3]) if len(args) > 3 else made.show(20, truncate=60)
        return 0
    if len(args) > 1 and args[0] == "validate":
        spark, bad = session("duolex"), 0
        for name in sorted(n for n in QUERIES if n.endswith("_violations")):
            for r in QUERIES[name](spark, args[1]).groupBy("severity", "rule").count().orderBy("severity", "rule").collect():
                print(f"{r.severity}: {r.rule}: {r['count']}")
                bad += r.severity == "error"
        return int(bad > 0 and "--strict" in args)
    if len(args) > 1 and args[0] in COMMANDS:
        spark = session("duolex")
        for name in (n for n in COMMANDS[args[0]] if n in QUERIES):
            made = QUERIES[name](spark, args[1])
            made.write.mode("overwrite").parquet(f"{args[2]}/{name}") if len(args) > 2 else made.show(20, truncate=60)
        return 0
    print("\n".join(["commands:", *sorted(COMMANDS), "validate", "queries:", *sorted(QUERIES)]))
    return int(args != ["list"])


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
