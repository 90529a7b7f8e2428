"""Which claim a blind reading holds."""

import pytest

from quire.operators import consensus as C

CASES = [
    ("1 cup 1 cup", "cup", "1 cup", "proposed"),  # every cup lies inside a longer claim
    ("2 cups sugar 2 cups sugar", "sugar", "2 cups sugar", "proposed"),
    ("2 cups sugar, then sugar", "sugar", "2 cups sugar", "none"),  # one stands outside
    ("1½ cups flour", "1 cups flour", "1 1/2 cups flour", "proposed"),
    ("½ cup", "1/2 cup", "1/4 cup", "current"),
    ("salt and pepper", "salt", "pepper", "none"),  # equal lengths, both there
    ("SALT", "salt", "salt", "proposed"),  # equal claims are the proposal
    ("a b a b a", "a", "a b a", "proposed"),  # places that overlap cover each other
    ("a-b", "a b", "a - b", "proposed"),
    ("x", "", "", "none"),
    (None, "a", "b", "none"),
    ("", "a", None, "none"),
]


@pytest.mark.parametrize("reading, current, proposed, vote", CASES)
def test_ballot(spark, reading, current, proposed, vote):
    rows = spark.createDataFrame([(reading, current, proposed, "x")], "reading string, current string, proposed string, name string")
    assert C.ballots(rows).first()["vote"] == vote


def test_nothing(spark):
    assert C.ballots(spark.createDataFrame([], "reading string, current string, proposed string")).count() == 0
