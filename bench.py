"""Times the headline queries: python bench.py, with BENCH_SF_DIR and BENCH_CPUS.

The relations are stored in their layout, read and kept, as a server keeps its
tables warm (``load``), and the aggregates are built and written (``build``);
each query then runs once untimed and REPEATS times timed, and its median
counts. ``fast_nodes`` reads the written aggregates. Answers run without
adaptive execution, builds and the pipeline with it. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))
ROUTES = (
    "people", "pmi_nodes", "pmi_nodes_by_surprise", "pmi_nodes_of_kind", "fast_nodes", "signature_top5", "cooccurrence_links", "sources_by_outlet", "docs_page", "docs_count",
    "docs_by_term", "timeline_week", "timeline_day", "timeline_term", "week_terms", "tone_matrix", "testimony_grouping_sets", "term_testimony", "rising_terms",
    "candidates", "compare_entities", "lenses", "agenda_share", "comention_pairs", "attention_series", "week_testimony", "build_person_terms", "doc_terms_build", "entity_tagging",
)
BUILDS = ("build_person_terms", "doc_terms_build", "entity_tagging")
PIPELINE = ("p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p6_found", "p7_found", "p8_found", "p9_mixture", "p10_found")


def main() -> None:
    from pyspark.sql import SparkSession

    from liame import catalogue
    from liame.plans.layout import served

    try:
        from liame.llm.catalogue import QUERIES as extra
    except ModuleNotFoundError as e:
        if e.name != "liame.llm":
            raise
        extra = {}
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    began = time.time()
    c = served(spark, FOLDER).persisted()
    for relation in (c.docs, c.doc_persons, c.doc_terms, c.terms, c.persons, c.candidates, c.phrases):
        relation.count()
    load = time.time() - began
    began = time.time()
    catalogue.aggregates(spark, FOLDER)
    build = time.time() - began
    times: dict[str, float] = {}
    for name in ROUTES:
        # An answer reads a few megabytes: re-planning between its stages costs more than it saves.
        spark.conf.set("spark.sql.adaptive.enabled", name in BUILDS)
        run = (lambda: catalogue.QUERIES["fast_nodes"](spark, FOLDER)) if name == "fast_nodes" else (lambda run=catalogue.OF_CORPUS[name]: run(c))
        run().collect()
        each = []
        for _ in range(REPEATS):
            t = time.time()
            run().collect()
            each.append(time.time() - t)
        times[name] = round(median(each), 3)
    spark.conf.set("spark.sql.adaptive.enabled", True)
    for name in PIPELINE if os.environ.get("BENCH_ROUTES_ONLY") is None else ():
        if name in extra:
            t = time.time()
            extra[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t, 3)
    spark.stop()
    print(json.dumps({"metric": "sum of query medians", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "load": round(load, 3), "build": round(build, 3), "sf": os.path.basename(FOLDER.rstrip("/"))}), file=sys.stdout)


if __name__ == "__main__":
    main()
