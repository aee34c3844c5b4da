"""python -m loomset.cli DIR metrics | schema | sql QUERY | overview START END | build-index INDEX | search INDEX QUERY [filters]"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from loomset.operators import catalog, gateway, index, kpi, retrieval
from loomset.plans.governed import VIEWS
from loomset.roles import records
from loomset.session import local_session


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="loomset")
    parser.add_argument("folder", help="where the Parquet tables are")
    verbs = parser.add_subparsers(dest="verb", required=True)
    verbs.add_parser("metrics")
    verbs.add_parser("schema")
    verbs.add_parser("sql").add_argument("query")
    overview = verbs.add_parser("overview")
    overview.add_argument("start")
    overview.add_argument("end")
    verbs.add_parser("build-index").add_argument("index", help="where the index is to be written")
    search = verbs.add_parser("search")
    search.add_argument("index")
    search.add_argument("query")
    for name in ("source", "lang"):
        search.add_argument(f"--{name}", default="")
    search.add_argument("--equal", action="append", default=[], metavar="COLUMN=VALUE", help="any other column of the chunks, case left aside; may be given again")
    search.add_argument("--date-column", default="date")
    search.add_argument("--date-from", help="both ends are included; dates are text, such as 2025-01-31")
    search.add_argument("--date-to")
    search.add_argument("--topic-id", type=int)
    search.add_argument("--top-k", type=int, default=8)
    asked = parser.parse_args(arguments)
    spark = local_session("loomset-cli")
    paths = {v: f"{asked.folder.rstrip('/')}/{v}.parquet" for v in VIEWS}
    if asked.verb == "metrics":
        out: object = catalog.metric_catalog()
    elif asked.verb == "schema":
        out = gateway.describe({v: spark.read.parquet(p) for v, p in paths.items()})
    elif asked.verb == "sql":
        columns, rows = gateway.collect(spark, asked.query, paths)
        out = {"columns": columns, "rows": [list(r) for r in rows]}  # MAX_ROWS at most
    elif asked.verb == "build-index":
        texts = spark.read.parquet(f"{asked.folder.rstrip('/')}/documents.parquet").drop("n_chars")
        out = index.save(index.build(texts, "doc_id", "text", "source"), asked.index)
    elif asked.verb == "search":
        opened = index.opened(spark, asked.index)
        equal = [("source", asked.source), ("lang", asked.lang), *((x.partition("=")[0], x.partition("=")[2]) for x in asked.equal)]
        used = {name for name, value in equal if value} | ({asked.date_column} if asked.date_from or asked.date_to else set())
        if unknown := sorted(used - set(opened.chunks.columns)):
            parser.error(f"the chunks have no column {', '.join(unknown)}")
        filters = retrieval.Filters(tuple(equal), asked.date_column, asked.date_from, asked.date_to, asked.topic_id)
        found = index.search(opened, asked.query, asked.top_k, filters)
        results = found.withColumns({"citation": retrieval.cite(F.col("doc_id"), F.lit(asked.index)), "excerpt": retrieval.excerpt(F.col("chunk_text"))}).drop("chunk_text")
        out = {"query": asked.query, "results": [r.asDict() for r in results.collect()]}  # top_k at most
    else:
        out = kpi.overview(kpi.monthly_kpis(records(spark, asked.folder)), asked.start, asked.end).first().asDict()
    print(json.dumps(out, ensure_ascii=False, default=str))


if __name__ == "__main__":
    main()
