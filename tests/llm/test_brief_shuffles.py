"""What lies on disk between the steps of a query."""

from __future__ import annotations

import os
import time

from ledgerline.llm import warc
from ledgerline.sources.scratch import Scratch


def shuffled(spark) -> int:
    """Bytes of all shuffle files."""
    tops = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    total = 0
    for folder, _, names in (found for top in tops for found in os.walk(top)):
        for name in names:
            if name.startswith("shuffle_"):
                try:
                    total += os.path.getsize(os.path.join(folder, name))
                except OSError:  # it went meanwhile
                    pass
    return total


def test_shuffled_payloads_go_before_the_archive_is_read(spark):
    Scratch(spark, "idle").release()
    time.sleep(1)
    before = shuffled(spark)
    pages = [(i, f"http://a.org/{i}", os.urandom(5000).hex()) for i in range(400)]  # 4 MB of bytes that do not compress below 2
    archive = warc.write_archive(spark, spark.createDataFrame(pages, "page_id long, url string, html string"), Scratch(spark, "warc").path)
    for _ in range(50):  # files go in the background
        if shuffled(spark) - before < 500_000:
            break
        time.sleep(0.1)
    assert shuffled(spark) - before < 500_000
    assert warc.read_index(spark, archive).filter("record_type = 'response' and payload_bytes = 10000").count() == 400
