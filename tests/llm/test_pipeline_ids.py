import zlib

from helpers import DOCS, prose

import corpus_pipeline


def test_the_last_stage_keeps_the_token_ids(spark):
    docs = spark.createDataFrame([(i, prose(i), "en", "s", 1) for i in range(5)], DOCS)
    got = corpus_pipeline.packing(spark, docs, "").collect()
    assert {r["doc_id"] for r in got} == set(range(5))
    assert all(len(r["ids"]) == 4 * r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in got)
