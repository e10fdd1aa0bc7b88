import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import filters, masks

SCHEMA = "id string, row long, categories string, update_date string, authors string"
KINDS = ["math.CO", "math.AG math.CO", "cs.X", None, "", "math.AC  math.CO math.CO", "math.COX", "math.AC"]


@pytest.fixture(scope="module")
def papers(spark):
    rng = random.Random(4)
    slots = rng.sample(range(100_000), 400) + [0, 7, 8, 32_767, 32_768, 65_535, 65_536]
    rows = [(f"p{s}", s, rng.choice(KINDS), "2020-01-01", "a") for s in slots] + [(f"w{k}", None, rng.choice(KINDS), "2020-01-01", "a") for k in range(60)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


ASKED = [["math.CO"], ["math.AC", "math.AG"], ["none"], ["math.AC", "math.CO", "math.AG"], []]


def test_counts_and_filters_by_masks(papers, monkeypatch):
    made = masks.category_masks(papers).cache()
    assert made.groupBy("category", "bucket").count().where("count > 1").count() == 0
    for asked in ASKED:
        own = filters.embedded(papers).where(filters.in_categories(asked))
        assert masks.count(masks.any_of(made, asked)).first()["n"] == own.count()
        for most in (64_000_000, 0):  # by broadcast, and by bucket
            monkeypatch.setattr(masks, "MASK_BYTES", most)
            found = masks.masked(papers, masks.any_of(made, asked), 100_000)
            assert found.columns == papers.columns and sorted(map(tuple, found.collect())) == sorted(map(tuple, own.collect()))
        if asked:
            assert masks.count_matching(papers, made, asked) == filters.narrow(papers, asked).count()


def test_all_of(papers):
    made = masks.category_masks(papers)
    for asked in ASKED[:-1]:
        own = filters.embedded(papers)
        for c in asked:
            own = own.where(filters.in_categories([c]))
        assert masks.count(masks.all_of(made, asked)).first()["n"] == own.count()


def test_no_papers(papers):
    made = masks.category_masks(papers.limit(0))
    assert made.count() == 0 and masks.count(masks.any_of(made, ["math.CO"])).first()["n"] == 0
    assert masks.masked(papers, masks.any_of(made, ["math.CO"]), 0).count() == 0
    assert masks.category_masks(papers.withColumn("row", F.lit(None).cast("long"))).count() == 0
