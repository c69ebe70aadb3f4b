"""Committee vote resolution (AGG16, SC24, K8).

Three agents (BUY, SELL, HOLD advocates) speak in turn; after each full
round of three turns the current votes are checked and the debate stops at
the first round with at most two distinct votes, or after turn 9.  At turn
9 the flow goes straight to the result, so the HOLD agent's vote is still
its round-2 vote (K8).  The majority of the three votes wins; a three-way
split falls back to ``tie_break``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TURNS = 9
AGENTS = ("BUY", "SELL", "HOLD")


def _majority(a: Column, b: Column, c: Column, tie_break: str) -> Column:
    return F.when((a == b) | (a == c), a).when(b == c, b).otherwise(F.lit(tie_break))


def _n_distinct(a: Column, b: Column, c: Column) -> Column:
    return F.size(F.array_distinct(F.array(a, b, c)))


def committee_consensus(votes: DataFrame, tie_break: str = "HOLD") -> DataFrame:
    """One row per debate: the deciding round (NULL when the debate stopped
    before any qualifying round), the decision and its vote count.  Votes are
    pivoted per debate with a grouped aggregate (nine turns at most)."""
    v = votes.groupBy("debate").agg(
        *[F.max(F.when(F.col("turn") == t, F.col("vote"))).alias(f"v{t}") for t in range(1, MAX_TURNS + 1)])
    rounds = {
        1: (F.col("v1"), F.col("v2"), F.col("v3")),
        2: (F.col("v4"), F.col("v5"), F.col("v6")),
        3: (F.col("v7"), F.col("v8"), F.col("v6")),  # K8: HOLD's turn-9 vote is never classified
    }
    complete = {1: F.col("v3").isNotNull() & F.col("v1").isNotNull() & F.col("v2").isNotNull(),
                2: F.col("v6").isNotNull() & F.col("v4").isNotNull() & F.col("v5").isNotNull(),
                3: F.col("v9").isNotNull() & F.col("v7").isNotNull() & F.col("v8").isNotNull()}
    ok1 = complete[1] & (_n_distinct(*rounds[1]) <= 2)
    ok2 = complete[1] & complete[2] & (_n_distinct(*rounds[2]) <= 2)
    ok3 = complete[1] & complete[2] & complete[3]
    rnd = F.when(ok1, 1).when(ok2, 2).when(ok3, 3)
    rnd_c = F.col("decided_round")
    decision = (F.when(rnd_c == 1, _majority(*rounds[1], tie_break)).when(rnd_c == 2, _majority(*rounds[2], tie_break))
                .when(rnd_c == 3, _majority(*rounds[3], tie_break)))
    v = v.withColumn("decided_round", rnd)
    out = v.select("debate", "decided_round", decision.alias("decision"), *rounds_cols(rounds))
    n_for = F.when(F.col("decided_round").isNotNull(),
                   F.expr("(CASE WHEN r1 = decision THEN 1 ELSE 0 END) + (CASE WHEN r2 = decision THEN 1 ELSE 0 END)"
                          " + (CASE WHEN r3 = decision THEN 1 ELSE 0 END)"))
    return out.select("debate", "decided_round", "decision", n_for.alias("votes_for"))


def rounds_cols(rounds) -> list[Column]:
    """The three votes of the deciding round as r1, r2, r3."""
    r = F.col("decided_round")
    return [F.when(r == 1, rounds[1][i]).when(r == 2, rounds[2][i]).when(r == 3, rounds[3][i]).alias(f"r{i + 1}")
            for i in range(3)]
