"""Quality rules by weak supervision, with DataFrame functions only.

Each rule looks at a text's own counts and votes good (1), bad (-1) or abstains (0).  Documents are summed
up per pattern of votes, of which there are at most 3 to the number of rules, and expectation-maximisation
over those patterns estimates how often each rule is right on good and on bad documents, and so the
probability of quality of each pattern.  Documents get their pattern's probability by an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil.llm.common import SPACE, cut, documents

#: Rules in order: (name, bad if, good if), over the fields of text_counts(); between the two they abstain.
#: Junk of one kind breaks several of them, so that the estimates can tell it from a good text's single slip.
RULES = [
    ("symbols", "n_symbols > 0.1 * n_words", "n_symbols <= 0.02 * n_words"),
    ("letters", "n_letters < 0.88 * word_chars", "n_letters >= 0.93 * word_chars"),
    ("symbol_lines", "n_symbol_lines > 0.3 * n_lines", "n_symbol_lines <= 0.05 * n_lines"),
    ("repeats", "n_repeat_words > 0.15 * n_words", "n_repeat_words <= 0.02 * n_words"),
    ("lines", "n_dup_lines > 0.3 * n_lines", "n_dup_lines <= 0.05 * n_lines"),
    ("capitals", "n_upper > 0.3 * word_chars", "n_upper <= 0.1 * word_chars"),
    ("variety", "n_variety < 0.4 * n_words", "n_variety >= 0.6 * n_words"),
    ("word_length", "word_chars < 2.0 * n_words OR word_chars > 7.0 * n_words", "word_chars BETWEEN 3.0 * n_words AND 6.5 * n_words"),
    ("sentences", "n_stops < 0.03 * n_words", "n_stops >= 0.04 * n_words"),
]
#: Different words are counted in stretches of so many and added up, as their share falls with the length of a text.
STRETCH = 100
ROUNDS = 25
#: A document is kept if its probability of quality is at least this.
LEAST_QUALITY = 0.5
#: Before the first round: share of good documents, and how often rules are right on good and on bad ones.
FIRST_SHARE, FIRST_RIGHT = 0.8, (0.9, 0.6)
#: Beta prior of every accuracy: votes that each rule is taken to have cast besides, right and wrong ones, on either class.
PRIOR_RIGHT, PRIOR_WRONG = 4.0, 1.0
#: Documents of either class that are taken to be there besides.
PRIOR_DOCS = 1.0


def text_counts(text: Column) -> dict[str, Column]:
    """Steps of columns; each may use those before it.  Words are runs of other than ASCII white space."""
    c = F.col
    longs = lambda x: x.cast("long")
    window = lambda of, shift, n: F.zip_with(F.slice(of, 1, F.greatest(n, F.lit(0))), F.slice(of, 1 + shift, F.greatest(n, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    n = F.size("_w")
    stretches = F.sequence(F.lit(0), F.floor(F.greatest(n - 1, F.lit(0)) / STRETCH).cast("int"))
    return {
        "_t": F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r")),
        "_w": F.when(c("_t") == "", F.array().cast("array<string>")).otherwise(F.split("_t", SPACE + "+")),
        "_l": F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike("[^" + SPACE[1:])),
        "_1": F.transform("_w", lambda w: F.xxhash64(w)),
        "_2": window(c("_1"), 1, n - 1),
        "_4": window(c("_2"), 2, n - 3),
        "_8": window(c("_4"), 4, n - 7),
        "n_words": longs(n),
        "word_chars": longs(F.length(F.concat_ws("", "_w"))),
        "n_symbols": longs(F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))),
        "n_dup_lines": longs(F.size("_l") - F.size(F.array_distinct("_l"))),
        "n_repeat_words": longs(F.when(F.size(F.array_distinct("_8")) < F.size("_8"), repeated_words(c("_8"))).otherwise(0)),
        "n_lines": longs(F.size("_l")),
        "n_upper": longs(F.length(F.regexp_replace("_t", r"\P{Lu}+", ""))),
        "n_letters": longs(F.length(F.regexp_replace("_t", r"\P{L}+", ""))),
        "n_stops": longs(F.length("_t") - F.length(F.regexp_replace("_t", rf"[.!?](?={SPACE}|\z)", ""))),
        "n_symbol_lines": longs(F.size(F.filter("_l", lambda x: x.rlike("[#*$%&|<>]")))),
        "n_variety": longs(F.aggregate(stretches, F.lit(0), lambda a, i: a + F.size(F.array_distinct(F.slice("_1", i * STRETCH + 1, STRETCH))))),
    }


def repeated_words(windows: Column, n: int = 8) -> Column:
    """Words within windows whose hash comes twice or more: those windows' places by sorting, then what they cover."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = F.transform(
        F.array(placed), lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
    )[0]
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    cover = F.aggregate(
        places,
        F.struct(F.lit(0).alias("to"), F.lit(0).alias("n")),
        lambda a, i: F.struct((i + n).alias("to"), (a["n"] + i + n - F.greatest(a["to"], i)).alias("n")),
    )
    return cover["n"]


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_variety", "n_letters", "n_stops", "n_symbol_lines"]


def with_votes(docs: DataFrame) -> DataFrame:
    """docs with a column _quality: a struct of the counts, base_failed and the votes.

    Null, empty and blank texts have no words and fail the base rules; very long texts are counted whole.  Repeated
    rows stay.  An empty table gives none.  Rows are held in a struct meanwhile, so column names may be any; a
    column _quality that the input has already is replaced.
    """
    held = docs.select(F.struct(*docs.columns).alias("_row")) if docs.columns else docs
    d = held
    for name, column in text_counts(F.col("_row.text")).items():
        d = d.withColumn(name, column)
    votes = F.array(*[F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0) for _, bad, good in RULES])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    d = d.select("_row", F.struct(*COUNTS, failed.alias("base_failed"), votes.alias("votes")).alias("_quality"))
    return d.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c != "_quality"], "_quality")


def pattern_quality(patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(votes, quality) given (votes, n): expectation-maximisation in one row over all patterns.

    The patterns are few (3 to the number of rules), so the row is small however many documents there are.
    """
    k = len(RULES)
    one = patterns.groupBy().agg(F.sort_array(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("p"))

    def quality(votes, s):
        """Probability of the good class: votes are independent given the class, abstaining says nothing."""
        odds = F.aggregate(
            F.arrays_zip(votes.alias("v"), s["good"].alias("g"), s["bad"].alias("b")),
            F.log((1 - s["share"]) / s["share"]),
            lambda a, x: a + F.when(x["v"] == 1, F.log((1 - x["b"]) / x["g"])).when(x["v"] == -1, F.log(x["b"] / (1 - x["g"]))).otherwise(0.0),
        )
        return 1 / (1 + F.exp(odds))

    def total(rows, value):
        return F.aggregate(rows, F.lit(0.0), lambda a, x: a + value(x))

    def state(share, good, bad):
        return F.struct(share.alias("share"), good.alias("good"), bad.alias("bad"))

    def round_(s, _):
        q = F.transform(F.col("p"), lambda x: F.struct(x["votes"].alias("votes"), (x["n"] * quality(x["votes"], s)).alias("g"), (x["n"] * (1 - quality(x["votes"], s))).alias("b")))
        return F.transform(F.array(q), lambda rows: update(rows))[0]

    def update(rows):
        right = lambda side, vote: F.array(
            *[
                (total(rows, lambda x, j=j: F.when(x["votes"][j] == vote, x[side]).otherwise(0.0)) + PRIOR_RIGHT)
                / (total(rows, lambda x, j=j: F.when(x["votes"][j] != 0, x[side]).otherwise(0.0)) + PRIOR_RIGHT + PRIOR_WRONG)
                for j in range(k)
            ]
        )
        good, bad = total(rows, lambda x: x["g"]), total(rows, lambda x: x["b"])
        return state((good + PRIOR_DOCS) / (good + bad + 2 * PRIOR_DOCS), right("g", 1), right("b", -1))

    first = state(F.lit(FIRST_SHARE), F.array_repeat(F.lit(FIRST_RIGHT[0]), k), F.array_repeat(F.lit(FIRST_RIGHT[1]), k))
    fitted = one.withColumn("s", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, round_))
    return fitted.select(F.explode("p").alias("x"), "s").select(F.col("x.votes").alias("votes"), quality(F.col("x.votes"), F.col("s")).alias("quality"))


def judge(voted: DataFrame, rounds: int = ROUNDS, least: float = LEAST_QUALITY) -> DataFrame:
    """with_votes() rows with _quality also holding quality and kept; base_failed rows are never kept.

    The rows are written once to the shared folder, so texts that the caller keeps are not counted twice.
    Equal votes have equal probabilities, so ties and repeated rows are judged alike.  An empty table gives no rows.
    """
    held = cut(voted, "quality-votes")
    patterns = cut(pattern_quality(held.groupBy(F.col("_quality.votes").alias("votes")).agg(F.count("*").alias("n")), rounds), "quality-patterns")
    # at most 3 ** len(RULES) rows
    patterns = F.broadcast(patterns.select(F.concat_ws(",", F.col("votes").cast("array<string>")).alias("_pattern"), F.col("quality").alias("_posterior")))
    joined = held.withColumn("_pattern", F.concat_ws(",", F.col("_quality.votes").cast("array<string>"))).join(patterns, "_pattern")
    kept = ~F.col("_quality.base_failed") & (F.col("_posterior") >= least)
    return joined.withColumn("_quality", F.col("_quality").withField("quality", F.col("_posterior")).withField("kept", kept)).drop("_pattern", "_posterior")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    voted = with_votes(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    q = lambda c: F.col("_quality")[c].alias(c)
    return judge(voted).select("doc_id", *map(q, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]))
