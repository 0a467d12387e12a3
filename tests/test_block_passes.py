"""The text is cut into blocks once for each pass: blocks serve the aggregate and the join back from one exchange."""

import re

from codesieve.operators import duplicates


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_copies_across_files_use_one_exchange_of_the_blocks(spark, files):
    block = "\n".join(f"line {i} of a block that is long enough to count" for i in range(8))
    found = duplicates.cross_file_duplicates(files(block, "x\n" + block, block + "\n  \n"), unique_paths=True)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(found.select("*"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(re.findall(r"ReusedExchange \[batch_id[^\]]*salt", text)) == 1
    assert len(found.where("file_ord > 0").collect()) == found.count() > 0


def test_the_second_pass_cuts_a_text_once(files):
    block = "\n".join(f"line {i} of a block that is long enough to count" for i in range(8))
    blocks = duplicates.file_blocks(files(block, block, "only\nhere\n" * 40), 3, 20, shared_only=True, bits=12)
    text = blocks._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("array_join(slice(") == 2  # for the hashes of all blocks and for the items of the chosen ones
    assert blocks.where("file_ord = 0").count() == 6
