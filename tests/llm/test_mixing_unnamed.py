"""Levels without a target keep their share, in the mix and in the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loglantern.llm import mixing
from loglantern.llm.queries import TARGETS


def test_unnamed_levels_keep_their_share():
    cells = [("en",), ("de",), ("other",)]
    fit = mixing.rake(cells, np.array([700.0, 200.0, 100.0]), [{"en": 0.5, "de": 0.5}])
    assert fit.wanted[0] == pytest.approx({"de": 0.45, "en": 0.45, "other": 0.1})
    assert fit.met[0] == pytest.approx(fit.wanted[0], abs=1e-4)
    assert mixing.rake([("other",)], np.array([5.0]), [{"en": 1.0}]).weight[0] > 0
    assert mixing.rake(cells, np.array([700.0, 200.0, 100.0]), [{"en": 0.5, "de": 0.5, "other": 0.0}]).weight[2] == 0


def test_documents_without_lang_or_of_a_fifth_language_are_drawn(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    few = F.col("doc_id") % 10
    odd = docs.withColumn("lang", F.when(few == 1, F.lit(None)).when(few == 2, F.lit("it")).otherwise(F.col("lang")))
    got = mixing.mix(odd, TARGETS)
    assert got.where("lang = 'other' AND n_tokens > 0 AND probability = 0").count() == 0
    assert got.where("lang = 'other' AND sampled").count() > 0
    langs = {r.lang for r in P.mixture(spark, odd, sf).select("lang").distinct().collect()}
    assert None in langs and "it" in langs
