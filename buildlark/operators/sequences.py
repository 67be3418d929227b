"""Builds as token sequences, and how trouble is spread over the length of a build."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from buildlark.functions import logtext
from buildlark.functions.scoring import count_if, ratio
from buildlark.operators.ordering import number_rows, range_buckets
from buildlark.session import settle

# Fixed values.
SEQ_LEN = 20
MAX_TOKENS = 30
PAD, UNK = 0, 1
PHASES = 5
_BLOCK = 1_000_000  # lines of a build that one join key takes


def tokenised(lines: DataFrame) -> DataFrame:
    """(build, pos, toks) of lines with build, pos, line."""
    return lines.select("build", "pos", logtext.sequence_tokens(F.col("line")).alias("toks"))


def vocabulary(toks: DataFrame, min_freq: int = 1) -> DataFrame:
    """(token, n, id): ids from 2 on in order of first appearance over builds and lines.

    Builds may be told by numbers, texts or structs: anything that can be ordered.
    """
    seen = toks.select("build", "pos", F.posexplode("toks").alias("i", "token"))
    counted = seen.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("build", "pos", "i")).alias("first")
    ).where(F.col("n") >= min_freq).select("token", "n", "first.*")
    # One row per token from here on; numbering reads them several times.
    counted = settle(counted, "tokens")
    cut = range_buckets(counted, ["build", "pos", "i"], "_bucket")
    numbered = number_rows(cut, [], "_bucket", [F.col("build"), F.col("pos"), F.col("i")], "_no")
    return numbered.select("token", "n", (F.col("_no") + UNK).cast("int").alias("id"))


def token_ids(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Add ``id`` to rows with a token: its number, 1 if it is unknown, NULL where token is NULL.

    No broadcast hint: a vocabulary has no fixed size, Spark broadcasts it where it is small and
    splits a hot token's rows where it is not.
    """
    coded = tokens.join(vocab.select("token", "id"), "token", "left")
    return coded.withColumn("id", F.when(F.col("token").isNotNull(), F.coalesce("id", F.lit(UNK))))


def leading(lines: DataFrame, value: str, n: int, pad) -> DataFrame:
    """(build, values): ``value`` of the first n lines of each build in order, padded with ``pad``."""
    by_pos = Window.partitionBy("build").orderBy("pos")
    lead = lines.withColumn("_n", F.row_number().over(by_pos)).where(F.col("_n") <= n)
    rows = lead.groupBy("build").agg(F.sort_array(F.collect_list(F.struct("_n", F.col(value).alias("v")))).alias("c"))
    values = F.transform("c", lambda x: x["v"])
    return rows.select("build", F.concat(values, F.array_repeat(F.lit(pad), F.lit(n) - F.size("c"))).alias("values"))


def encode(toks: DataFrame, vocab: DataFrame) -> DataFrame:
    """(build, ids): SEQ_LEN lines of MAX_TOKENS ids per build, padded with 0.

    Cut to the leading lines and tokens before the vocabulary join, so a build takes at most
    SEQ_LEN * MAX_TOKENS rows through it however long it is.
    """
    by_pos = Window.partitionBy("build").orderBy("pos")
    lead = (
        toks.withColumn("line_no", F.row_number().over(by_pos)).where(F.col("line_no") <= SEQ_LEN)
        .select("build", "line_no", F.posexplode_outer(F.slice("toks", 1, MAX_TOKENS)).alias("i", "token"))
    )
    coded = token_ids(lead, vocab).select("build", "line_no", "i", "id")
    cells = coded.groupBy("build").agg(
        F.sort_array(F.collect_list(F.struct("line_no", "i", "id"))).alias("cells")
    )

    def line_ids(k):
        ids = F.transform(
            F.filter("cells", lambda c: (c["line_no"] == k) & c["id"].isNotNull()), lambda c: c["id"]
        )
        return F.concat(ids, F.array_repeat(F.lit(PAD), F.lit(MAX_TOKENS) - F.size(ids)))

    return cells.select("build", F.transform(F.sequence(F.lit(1), F.lit(SEQ_LEN)), line_ids).alias("ids"))


def phased(lines: DataFrame) -> DataFrame:
    """Add ``phase`` 0..4: the fifth of its build a line lies in, by dense position from 0."""
    sizes = lines.groupBy("build").agg((F.max("pos") + 1).alias("n_lines"))
    # A build may be a large share of all lines: one join key per block of it. Small builds have one.
    last = F.floor((F.col("n_lines") - 1) / _BLOCK)
    blocks = sizes.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    dealt = lines.withColumn("_block", F.floor(F.col("pos") / _BLOCK))
    joined = dealt.join(blocks, ["build", "_block"]).drop("_block")
    phase = F.least(F.lit(PHASES - 1), F.floor(F.col("pos") * PHASES / F.col("n_lines")))
    return joined.withColumn("phase", phase.cast("int"))


def escalation(lines: DataFrame) -> DataFrame:
    """Per build: severity by fifth, where the last error lies, and errors in the last two fifths."""
    low = logtext.count_error_matches(lines, "line", "errors")
    judged = phased(low).withColumn("sev", logtext.severity(logtext.level(F.col("line"))))
    warn = (F.col("sev") == 3).cast("int")
    aggs = [F.max("n_lines").alias("n_lines")]
    for k in range(PHASES):
        here = F.col("phase") == k
        aggs.append(F.sum(F.when(here, F.col("sev"))).alias(f"_s{k}"))
        aggs.append(F.count(F.when(here, 1)).alias(f"_c{k}"))
        aggs.append(F.coalesce(F.max(F.when(here, F.col("sev"))), F.lit(0)).alias(f"sev_max_{k}"))
    late = F.col("phase") >= PHASES - 2
    aggs += [
        count_if((F.col("errors") > 0) & late).alias("late_errors"),
        count_if(F.col("errors") > 0).alias("errors"),
        F.coalesce(F.max(F.when(F.col("errors") > 0, F.col("pos"))), F.lit(-1)).alias("last_error_pos"),
        F.sum(F.when(late, warn)).alias("_late_warn"),
        F.sum(F.when(F.col("phase") < 2, warn)).alias("_early_warn"),
    ]
    out = judged.groupBy("build").agg(*aggs)
    means = [ratio(F.col(f"_s{k}"), F.col(f"_c{k}")).alias(f"sev_mean_{k}") for k in range(PHASES)]
    return out.select(
        "build", "n_lines", *means, *[f"sev_max_{k}" for k in range(PHASES)], "errors", "late_errors",
        ((F.col("last_error_pos") + 1) / F.col("n_lines")).alias("last_error_at"),
        (F.coalesce("_late_warn", F.lit(0)) - F.coalesce("_early_warn", F.lit(0))).alias("warn_rise"),
    )
