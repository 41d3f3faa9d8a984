"""A rare toxic word is found beside more common features than any cut would leave."""

import random
import zlib

from lodestone.llm import toxicity


def test_rare_word_beside_many_common_ones(spark):
    r = random.Random(4)
    common = " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(25_000))
    assert len(toxicity._features(common)) > 50_000
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5][:24]
    rows = [(i, common + " blorgh" * (j < 8)) for j, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(j < 12)) for j, i in enumerate(ids)], "doc_id long, toxic int")
    assert "blorgh" in toxicity.fit(df, labels).lexicon
