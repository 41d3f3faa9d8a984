"""Time exact and indexed top-k over one Parquet table.

    python vector_bench.py --path data.parquet --k 100 --nprobe 16
    python vector_bench.py --rows 200000 --dim 64          # made-up data
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def options() -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--path", help="a Parquet table; made up if not given")
    p.add_argument("--rows", type=int, default=100_000)
    p.add_argument("--dim", type=int, default=64)
    p.add_argument("--vector-column", help="the first column of float lists by default")
    p.add_argument("--id-column", help="what recall compares; file and row by default")
    p.add_argument("--build-mode", choices=("rewrite", "in-place", "both"), default="rewrite")
    p.add_argument("--n-clusters", type=int)
    p.add_argument("--k", type=int, default=100)
    p.add_argument("--nprobe", type=int, default=16)
    p.add_argument("--max-candidates", type=int)
    p.add_argument("--query-row", type=int, default=0, help="the row, in the order of files, whose vector is looked for")
    p.add_argument("--metrics", action="store_true", help="count candidates too")
    p.add_argument("--cpus", type=int, default=8)
    return p.parse_args()


def timed(df: DataFrame) -> tuple[float, list]:
    began = time.time()
    rows = df.collect()
    return round(time.time() - began, 4), rows


def main() -> None:
    from lodestone import IndexBuilder
    from lodestone.functions import vector_column
    from lodestone.operators import exact_topk
    from lodestone.scratch import new_path
    from lodestone.sources import generate, identified

    o = options()
    spark = SparkSession.builder.master(f"local[{o.cpus}]").config("spark.sql.shuffle.partitions", o.cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    path = o.path
    if path is None:
        path = new_path(spark)
        generate(spark, o.rows, o.dim).write.parquet(path)
    table = identified(spark, path)
    column = o.vector_column or vector_column(table)
    key = ["_ivf_file", "_ivf_row"]
    names = [o.id_column] if o.id_column else key
    query = table.orderBy(*key).offset(o.query_row).select(column).first()[0]
    seconds, truth = timed(exact_topk(table, column, query, o.k, key).select(*names))
    out: dict = {"rows": table.count(), "k": o.k, "nprobe": o.nprobe, "exact_seconds": seconds}
    for mode in ("rewrite", "in-place") if o.build_mode == "both" else (o.build_mode,):
        builder = IndexBuilder(spark, path, column)
        if o.n_clusters:
            builder.n_clusters(o.n_clusters)
        began = time.time()
        index = builder.build_new(new_path(spark)) if mode == "rewrite" else builder.build_inplace()
        found: dict = {"build_seconds": round(time.time() - began, 4), "clusters": index.manifest.clusters}
        near = index.search(query, o.k, o.nprobe, cap=o.max_candidates).select(*names)
        found["seconds"], rows = timed(near)
        found["recall"] = len({tuple(r) for r in rows} & {tuple(r) for r in truth}) / len(truth) if truth else 0.0
        if o.metrics:
            found["candidate_rows"] = index.candidates(query, o.nprobe, o.max_candidates).agg(F.count("*")).first()[0]
        out[mode] = found
    print(json.dumps(out))


if __name__ == "__main__":
    main()
