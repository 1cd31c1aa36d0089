"""Scoring holds a bounded amount of text in a worker."""

import pytest
from oracle import SF_SMALL

from tonelake.operators import scoring
from tonelake.session import BATCH_BYTES, BATCH_DEFAULT, BATCH_SETTING
from tonelake.sources import synthetic


@pytest.mark.parametrize("step", [lambda items: scoring.ask(scoring.prompts(items), str.upper), lambda items: scoring.classify(items, lambda texts: [("neutral", 0.5)] * len(texts))])
def test_batches_are_bounded_by_bytes(spark, step):
    before = spark.conf.get(BATCH_SETTING)
    try:
        for given, wanted in ((BATCH_DEFAULT, str(BATCH_BYTES)), ("1000000", "1000000")):
            spark.conf.set(BATCH_SETTING, given)
            assert step(synthetic.items(spark, SF_SMALL)).count() > 0
            assert spark.conf.get(BATCH_SETTING) == wanted
    finally:
        spark.conf.set(BATCH_SETTING, before)
