"""Build an index over made-up vectors, then search it directly and from SQL.

    PYTHONPATH=. python examples/build_and_search.py
"""

from pyspark.sql import SparkSession

from lodestone import IndexBuilder, TopkBuilder, VectorTopKOptions, enable_vector_search
from lodestone.scratch import new_path
from lodestone.sources import embedding_at, generate

spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").getOrCreate()
source, indexed = new_path(spark), new_path(spark)
generate(spark, 5000, 32).write.parquet(source)

index = IndexBuilder(spark, source, "embedding").n_clusters(50).option("compression", "zstd").build_new(indexed)
query = embedding_at(spark.read.parquet(source), "embedding", "id", 17)

index.search(query, k=5, nprobe=8).select("id", "distance").show()
TopkBuilder(spark, indexed, query).k(5).nprobe(8).search().show(truncate=False)

session = enable_vector_search(spark, VectorTopKOptions(nprobe=8))
session.register("items", indexed)
found = session.query(f"SELECT id FROM items WHERE id >= 100 ORDER BY array_distance(embedding, array({', '.join(f'{x}D' for x in query)})) LIMIT 5")
print(found.explain())
found.df.show()
print(found.metrics())
spark.stop()
