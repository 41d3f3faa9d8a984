"""An index beside the data, whose files stay as they are, and a stream assigned to its clusters.

    PYTHONPATH=. python examples/beside_the_data.py
"""

from pyspark.sql import SparkSession

from lodestone import IndexBuilder
from lodestone.scratch import new_path
from lodestone.sources import generate, read_index
from lodestone.streaming import assign_stream

spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").getOrCreate()
path = new_path(spark)
generate(spark, 5000, 32).write.parquet(path)
IndexBuilder(spark, path, "embedding").build_inplace()
index = read_index(spark, path)
index.search([0.5] * 32, k=5, nprobe=8).select("id", "distance").show()

arriving = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
run = assign_stream(arriving, index).groupBy("cluster_id").count().writeStream.format("memory").queryName("sizes").outputMode("complete").trigger(availableNow=True).start()
run.awaitTermination()
spark.table("sizes").orderBy("cluster_id").show(5)
spark.stop()
