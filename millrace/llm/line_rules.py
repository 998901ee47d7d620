"""Quality rules of a document, and lines that a host repeats across its documents. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WORD_GAP, never_broadcast, order_id, stored

GAP_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def with_rules(
    df: DataFrame,
    text: str = "text",
    window: int = 8,
    min_words: int = 20,
    max_repeat_percent: int = 30,
) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    All is worked out inside the row: window hashes are sorted with their
    places, neighbours of equal hash are repeats, and the words they cover are
    the summed gaps between repeats, at most ``window`` each. Null text has no
    words and fails. Nothing is shuffled. Each step is bound to a name inside
    one expression, so that a filter on a rule can be pushed down without the
    steps being written out again and again.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def rules(t: Column) -> Column:
        words = F.filter(F.split(t, WORD_GAP), lambda w: w != "")
        lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, GAP_CHARS, "")) > 0)
        values = [
            F.length(F.translate(t, GAP_CHARS, "")),
            _count(t, SYMBOLS),
            _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        ]
        counted = lambda h: [F.size(h), *values, _repeated_words(h, window)]
        return _let(
            F.transform(words, lambda w: F.xxhash64(w)),
            lambda h: F.struct(*[v.cast("long").alias(n) for v, n in zip(counted(h), new, strict=True)]),
        )

    def judged(r: Column) -> Column:
        failed = (r["n_words"] < min_words) | (r["n_repeat_words"] * 100 > r["n_words"] * max_repeat_percent)
        return F.struct(*[r[n].alias(n) for n in new], failed.alias("base_failed"))

    (here,) = free_names(df, "rules")
    out = df.withColumn(here, _let(_let(F.coalesce(F.col(text), F.lit("")), rules), judged))
    names = [*new, "base_failed"]
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in names], *[F.col(here)[n].alias(n) for n in names])


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores behind it as keep it apart from the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated_words(hashes: Column, window: int) -> Column:
    """Words in windows that occur twice or more, from the word hashes of a text."""
    starts = F.sequence(F.lit(1), F.size(hashes) - F.lit(window - 1))
    wins = F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, window)))

    def beside(ranked: Column) -> Column:
        twin = lambda x, i, step: F.get(ranked, i + step)["h"].eqNullSafe(x["h"])
        marked = F.transform(ranked, lambda x, i: F.when(twin(x, i, -1) | twin(x, i, 1), x["i"]))
        return F.sort_array(F.filter(marked, lambda x: x.isNotNull()))

    def covered(places: Column) -> Column:
        gap = F.transform(places, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(places, i + 1) - p, F.lit(window))))
        return F.aggregate(gap, F.lit(0), lambda a, x: a + x)

    def total(w: Column) -> Column:
        ranked = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) < F.size(w), _let(_let(ranked, beside), covered)).otherwise(0)

    return F.when(F.size(hashes) >= window, _let(wins, total)).otherwise(0)


def line_table(df: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: order id o, text hash v, host, and lines as an array of (hash h, words w, place p).

    The place of a line counts all parts of the text between newlines from 0. A line is normalised to lower case with digits as 0 and gaps as one space; empty lines are left out.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    plain = F.regexp_replace(F.regexp_replace(F.lower(t), r"[\x20\x09\x0B-\x0D]+", " "), "[0-9]", "0")
    placed = F.transform(F.split(plain, "\n"), lambda x, i: F.struct(F.trim(x).alias("x"), i.alias("p")))
    lines = F.filter(placed, lambda x: x["x"] != "")
    marked = F.transform(
        lines, lambda x: F.struct(F.xxhash64(x["x"]).alias("h"), F.size(F.split(x["x"], " ")).alias("w"), x["p"].alias("p"))
    )
    return df.select(order_id(doc_id).alias("o"), F.xxhash64(t).alias("v"), _host(host).alias("host"), marked.alias("lines"))


def _host(host: str) -> Column:
    return F.coalesce(F.col(host).cast("string"), F.lit(""))


def frequent_lines(table: DataFrame, limit_documents: int) -> DataFrame:
    """Places of lines that stand in more than ``limit_documents`` documents of their host, but for the first of these.

    Columns o, v, host, p (place) and w (words). Rows are counted first, summed
    before the shuffle, so that a line of a third of all rows is one row per task.
    Only lines that pass by rows are then counted by distinct ids.
    """
    each = table.select("o", "v", "host", F.explode("lines").alias("x")).select("o", "v", "host", "x.h", "x.p", "x.w")
    once = table.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    maybe = once.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > limit_documents).select("host", "h")
    hits = stored(each.join(never_broadcast(maybe), ["host", "h"]))
    counts = hits.select("host", "h", "o").distinct().groupBy("host", "h").agg(F.count("*").alias("n"), F.min("o").alias("first"))
    often = counts.where(F.col("n") > limit_documents).select("host", "h", "first")
    hit = hits.join(never_broadcast(often), ["host", "h"]).where(F.col("o") != F.col("first"))
    return hit.groupBy("o", "v", "host", "p").agg(F.max("w").alias("w"))  # repeated rows tell a line once


def quality_rules(
    df: DataFrame,
    text: str = "text",
    host: str = "source",
    doc_id: str = "doc_id",
    limit_documents: int = 20,
    min_left: float = 0.2,
) -> DataFrame:
    """All columns of ``df`` with the rules of ``with_rules``, n_line_words, kept and kept_text.

    A normalised line counts once per document id and host. Lines in more than
    ``limit_documents`` documents of a host, however large it is, are removed
    everywhere but in the first document (smallest id) that holds them; kept_text
    is the text without them, with the other lines unchanged. A document that keeps less than
    ``min_left`` of its words is depleted and not kept, as are documents that fail
    the base rules. Null hosts are one host; null ids come last and are one
    document for the counts; rows that repeat an id are told apart by text. Null
    and empty texts have no lines and fail. No rows are dropped, an empty table
    gives none; columns of ``df`` with the name of a result are replaced, all
    others stay. The lines of all texts, as hashes, are written once to the shared
    folder.
    """
    single = frequent_lines(stored(line_table(df, text, host, doc_id)), limit_documents)
    gone = single.groupBy("o", "v", "host").agg(F.sum("w").alias("gone"), F.collect_list("p").alias("places"))
    ruled = with_rules(df, text)
    names = free_names(ruled, "line_o", "line_v", "line_host", "line_gone", "line_places")
    o, v, h, words, places = names
    keyed = ruled.withColumns({o: order_id(doc_id), v: F.xxhash64(F.coalesce(F.col(text), F.lit(""))), h: _host(host)})
    joined = keyed.join(gone.toDF(*names), [o, v, h], "left")
    n_line = F.least(F.coalesce(F.col(words), F.lit(0)), F.col("n_words")).cast("long")
    depleted = (F.col("n_words") - n_line) < F.col("n_words") * F.lit(min_left)
    lines = F.split(F.col(text), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(places))
    without = _let(F.struct(lines.alias("lines"), left.alias("left")), lambda x: F.array_join(F.transform(x["left"], lambda i: F.get(x["lines"], i)), "\n"))
    new = {
        "n_line_words": n_line,
        "kept": ~F.col("base_failed") & ~depleted,
        "kept_text": F.when(F.col(places).isNull(), F.col(text)).otherwise(without),
    }
    plain = [F.col(f"`{c}`") for c in ruled.columns if c not in new]
    return joined.select(*plain, *[value.alias(name) for name, value in new.items()])
