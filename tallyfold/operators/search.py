"""Company lookup: prefix search and resolution of ticker requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyfold.functions.columns import alnum_key, ticker_key
from tallyfold.operators.ordered import newest_per
from tallyfold.session import cut_lineage

c = F.col


def search_companies(metrics: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Tickers that match a prefix; ``%`` and ``_`` in the query act as wildcards."""
    q = (query or "").strip().upper()
    names = metrics.select("ticker")
    if not q:
        return names.where(F.lit(False))
    hit = c("ticker").like(q.replace("\\", "\\\\") + "%") if any(x in q for x in "%_") else c("ticker").startswith(q)
    return names.where(hit).distinct().orderBy("ticker").limit(limit)


def _prefixes(tickers: DataFrame, lengths: DataFrame) -> DataFrame:
    spread = F.explode(F.sequence(F.lit(1), F.length("ticker")))
    rows = tickers.where(F.length("ticker") > 0).select("ticker", spread.alias("n"))
    return rows.join(lengths, "n").select("ticker", F.expr("substring(ticker, 1, n)").alias("prefix"))


# Letters of upper-case text from rare to common, for the candidate filter only:
# any fixed order gives the same result.
RARE_FIRST = "QZXJKVWYFBGHMPUDCLONTRISAE"


def _tokens(text: Column) -> Column:
    """Characters with a running number per character, rare ones first."""
    chars = F.filter(F.split(text, ""), lambda x: x != "")
    numbered = F.transform(chars, lambda x, i: F.struct(
        F.position(x, F.lit(RARE_FIRST)).alias("o"), x.alias("c"),
        F.size(F.filter(F.slice(chars, 1, i + 1), lambda y: y == x)).alias("k")))
    return F.sort_array(numbered)


def _with_filter_keys(df: DataFrame, name: str, cutoff: float, other: str) -> DataFrame:
    """Explode keys of which two close texts must share at least one.

    Texts of lengths n and m within ``(1 - cutoff) * max(n, m)`` edits have at
    least ``need = max(n, m)`` less that many characters in common. With all
    characters in one fixed order the first two of those are among the first
    ``n - need + 2`` of each text, so a key is both lengths and a pair of
    characters (one character where ``need`` is 1).
    """
    size = F.length(name)
    lengths = F.sequence(F.greatest(F.ceil(size * cutoff - 1e-9).cast("int"), F.lit(1)), F.floor(size / cutoff + 1e-9).cast("int"))
    rows = df.withColumns({"__n": size, "__tokens": _tokens(c(name))}).withColumn("__m", F.explode(lengths))
    longest = F.greatest("__n", "__m")
    need = longest - F.floor(longest * (1 - cutoff) + 1e-9).cast("int")
    rows = rows.withColumns({"__need": need, "__first": F.slice("__tokens", 1, F.greatest(c("__n") - need + F.when(need > 1, 2).otherwise(1), F.lit(1)))})
    single = F.transform("__first", lambda x: F.array(x))
    pairs = F.flatten(F.transform("__first", lambda x, i: F.transform(F.slice("__first", i + 2, F.size("__first")), lambda y: F.array(x, y))))
    mine, others = ("__n", "__m") if other == "right" else ("__m", "__n")
    return rows.select(name, c(mine).alias("__a"), c(others).alias("__b"), F.explode(F.when(c("__need") > 1, pairs).otherwise(single)).alias("__t"))


def close_matches(requests: DataFrame, tickers: DataFrame, n: int = 5, cutoff: float = 0.6) -> DataFrame:
    """Up to n closest tickers per ``word``, best first: ``1 - edits / longer length`` of at least ``cutoff``.

    Candidates come from an equi-join on both lengths and a pair of characters,
    never from all pairs; the edit distance decides. Ties go to the larger ticker.
    """
    words = requests.select("word").where(c("word") != "").distinct()
    names = tickers.select("ticker").where(c("ticker") != "").distinct()
    a, b = _with_filter_keys(words, "word", cutoff, "right"), _with_filter_keys(names, "ticker", cutoff, "left")
    pairs = a.join(b, ["__a", "__b", "__t"]).select("word", "ticker").distinct()
    longest = F.greatest(F.length("word"), F.length("ticker"))
    scored = pairs.withColumn("score", 1 - F.levenshtein("word", "ticker") / longest).where(c("score") >= cutoff - 1e-9)
    w = W.partitionBy("word").orderBy(c("score").desc(), c("ticker").desc())
    return scored.withColumn("rank", F.row_number().over(w)).where(c("rank") <= n)


def resolve_tickers(requests: DataFrame, tickers: DataFrame) -> DataFrame:
    """Resolve requested tickers: exact, else the only prefix match, else the request itself.

    Output: requested, resolved, exact, candidates (at most five, prefix
    matches first, close matches when there is none).
    """
    known = cut_lineage(tickers.select("ticker").distinct())
    asked = requests.select(F.trim("requested").alias("requested")).distinct().withColumn("word", ticker_key(c("requested")))
    hit = known.select(c("ticker").alias("word"), F.lit(True).alias("__exact"))
    asked = cut_lineage(asked.join(hit, "word", "left"))
    open_ = asked.where(c("__exact").isNull() & (c("word") != ""))
    lengths = open_.select(F.length("word").alias("n")).distinct()
    wanted = open_.select(c("word").alias("prefix")).distinct()
    table = cut_lineage(_prefixes(known, lengths).join(wanted, "prefix", "left_semi"))
    counts = table.groupBy("prefix").agg(F.count("*").alias("__n"))
    first = newest_per(table, ["prefix"], [c("ticker")], 5).groupBy("prefix").agg(
        F.sort_array(F.collect_list("ticker")).alias("__prefixed"))
    none = open_.join(counts, c("word") == c("prefix"), "left_anti")
    close = close_matches(none, known).groupBy("word").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "ticker"))), lambda x: x["ticker"]).alias("__close"))
    empty = F.array().cast("array<string>")
    only = F.when(c("__n") == 1, c("__prefixed")[0])
    return (
        asked.join(counts.join(first, "prefix").withColumnRenamed("prefix", "word"), "word", "left")
        .join(close, "word", "left")
        .select(
            "requested",
            F.when(c("word") == "", F.when(c("requested") != "", F.upper("requested"))).when(c("__exact"), c("word"))
            .otherwise(F.coalesce(only, c("word"))).alias("resolved"),
            F.coalesce("__exact", F.lit(False)).alias("exact"),
            F.when(c("__exact"), F.array("word")).otherwise(F.coalesce("__prefixed", "__close", empty)).alias("candidates"),
        )
    )


def _allowed(longest: Column, cutoff: float) -> Column:
    """How many edits two texts may differ by, given the longer length."""
    return F.floor(longest * (1 - cutoff) + 1e-9).cast("int")


def _lengths(name: str, cutoff: float) -> Column:
    """The lengths that a text close to this one may have."""
    size = F.length(name)
    return F.sequence(F.greatest(F.ceil(size * cutoff - 1e-9).cast("int"), F.lit(1)), F.floor(size / cutoff + 1e-9).cast("int"))


def _pieces(df: DataFrame, name: str, cutoff: float, mine: str, others: str, cut: bool) -> DataFrame:
    """Keys of which two texts within k edits share one: both lengths, the number of a piece and its characters.

    The one side is cut into k + 1 even pieces, of which k edits leave one as it is
    (``cut``). The other side gives what stands in its text where that piece can be: with i
    pieces before it and k - i behind, the first piece left whole has moved by at most i places
    counted from the start, and by at most k - i counted from the end.
    """
    rows = df.select(name, F.length(name).alias(mine), F.explode(_lengths(name, cutoff)).alias(others))
    size = c("__b")  # of the text that is cut
    rows = rows.withColumn("__k", _allowed(F.greatest("__a", "__b"), cutoff))
    start = lambda i: F.floor(size * i / (c("__k") + 1)).cast("int")
    width = lambda i: start(i + 1) - start(i)
    shift = c("__a") - c("__b")  # how much longer the other side is

    def piece(i: Column, at: Column) -> Column:
        return F.struct(i.alias("i"), F.substr(name, at + 1, width(i)).alias("text"))

    numbers = F.sequence(F.lit(0), c("__k"))
    if cut:
        keys = F.transform(numbers, lambda i: piece(i, start(i)))
    else:
        def places(i: Column) -> Column:
            low = F.greatest(start(i) - i, start(i) + shift - (c("__k") - i), F.lit(0))
            high = F.least(start(i) + i, start(i) + shift + (c("__k") - i), c("__a") - width(i))
            return F.when(low <= high, F.transform(F.sequence(low, F.greatest(low, high)), lambda at: piece(i, at))).otherwise(
                F.array().cast("array<struct<i:int,text:string>>"))

        keys = F.array_distinct(F.flatten(F.transform(numbers, places)))
    return rows.select(name, mine, others, F.explode(keys).alias("__key"))


def close_names(words: DataFrame, names: DataFrame, cutoff: float = 0.8, q: int = 2) -> DataFrame:
    """``word``, ``name`` and ``edits`` of all pairs with at most ``(1 - cutoff)`` of the longer length in edits.

    An equi-join on both lengths and a piece of the name proposes pairs, the edit
    distance decides before pairs are made distinct; nothing is missed. ``q`` times
    ``1 - cutoff`` must be below one: shorter pieces would tell nothing apart.
    """
    if q * (1 - cutoff) >= 1:
        raise ValueError("pieces of this length can't filter at this cutoff")
    left, right = words.select("word").where(c("word") != "").distinct(), names.select("name").where(c("name") != "").distinct()
    a = _pieces(left, "word", cutoff, "__a", "__b", False)
    b = _pieces(right, "name", cutoff, "__b", "__a", True)
    limit = _allowed(F.greatest("__a", "__b"), cutoff)
    near = a.join(b, ["__a", "__b", "__key"]).select("word", "name", F.levenshtein("word", "name").alias("edits"), limit.alias("__limit"))
    return near.where(c("edits") <= c("__limit")).select("word", "name", "edits").distinct()


def resolve_entities(mentions: DataFrame, companies: DataFrame, cutoff: float | None = None) -> DataFrame:
    """Mentions (cik, symbol, name) to companies (cik, ticker, name): by CIK, then ticker, then exact name.

    With a ``cutoff`` the mentions still open go to the closest name of at least
    that similarity (:func:`close_names`); ties go to the smaller name, then ticker.
    A mention without a key takes part under a key of its own that no company
    has, so missing keys don't meet in one task.
    """
    row = F.xxhash64(*[F.coalesce(c(x).cast("string"), F.lit("")) for x in ("cik", "symbol", "name")])
    none = F.concat(F.lit("\u0000"), row.cast("string"))
    m = mentions.withColumns({
        "__cik": F.coalesce(c("cik").try_cast("long").cast("string"), none), "__sym": F.coalesce(ticker_key(c("symbol")), none),
        "__name": F.coalesce(alnum_key(c("name")), none)})
    by_cik = companies.select(c("cik").try_cast("long").cast("string").alias("__cik"), c("ticker").alias("t1")).where(c("__cik").isNotNull()).groupBy("__cik").agg(F.min("t1").alias("t1"))
    by_sym = companies.select(c("ticker").alias("__sym"), c("ticker").alias("t2")).where(c("__sym").isNotNull()).distinct()
    by_name = companies.select(alnum_key(c("name")).alias("__name"), c("ticker").alias("t3")).where(c("__name").isNotNull()).groupBy("__name").agg(F.min("t3").alias("t3"))
    out = m.join(by_cik, "__cik", "left").join(by_sym, "__sym", "left").join(by_name, "__name", "left")
    how = F.when(c("t1").isNotNull(), "cik").when(c("t2").isNotNull(), "ticker").when(c("t3").isNotNull(), "name")
    if cutoff is not None:
        open_ = out.where(how.isNull() & c("name").isNotNull()).select(c("__name").alias("word"))
        close = close_names(open_, by_name.select(c("__name").alias("name")), cutoff).join(by_name.withColumnRenamed("__name", "name"), "name")
        best = close.groupBy("word").agg(F.min_by("t3", F.struct("edits", "name", "t3")).alias("t4"))
        out = out.join(best.withColumnRenamed("word", "__name"), "__name", "left")
        how = how.when(c("t4").isNotNull(), "fuzzy")
    last = [c("t4")] if cutoff is not None else []
    return out.select(*mentions.columns, F.coalesce("t1", "t2", "t3", *last).alias("resolved"), how.otherwise("none").alias("resolved_by"))
