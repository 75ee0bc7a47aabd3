"""Every surveyed reason of a miss can come out of the query."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from passagemill.plans.catalogue import QUERIES

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_questions_that_name_another_scheme(spark, tmp_path):
    for f in DATA.glob("*.parquet"):
        if f.stem != "gold_question":
            (tmp_path / f.name).symlink_to(f)
    gold = spark.read.parquet(f"{DATA}/gold_question.parquet")
    gold.withColumn("expected_source_id", F.lit("no such source")).write.parquet(f"{tmp_path}/gold_question.parquet")
    named = QUERIES["question_schemes"](spark, str(DATA)).where("slug is not null").count()
    got = {r.reason: r.n for r in QUERIES["gold_reasons"](spark, str(tmp_path)).collect()}
    assert named > 0 and got["filter_chose_wrong_scheme"] == named and sum(got.values()) == gold.count()
