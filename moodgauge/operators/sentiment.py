"""Rule-based sentiment over clauses (H1, the whole rule set).

Every rule is a set operation: tokens with their neighbours are exploded from
the text, looked up in the lexicon and the idiom table by hash joins, and
summed per row; no text is gone through by a user function. Definitions
(constants from Hutto & Gilbert, ICWSM 2014; equality with a library is not
claimed):

* A token is a run of letters and digits. ``. , ; : ! ?`` and line ends part
  clauses; the three tokens before a token count only as far as its clause
  goes.
* The valence of a token is that of the longest idiom (of two or three tokens
  in a row, within a clause) that ends with it, else that of its lower-cased
  form in the lexicon, else 0. The rules below apply to valences other than 0.
* Emphasis: a token in capitals (two characters or more, no small letter) of
  a text that has both such tokens and others: the valence moves away from 0.
* Boosters 1, 2 or 3 tokens back add to the size of the valence, with falling
  weight; a booster in capitals, in such a text, adds more.
* A negation 1, 2 or 3 tokens back multiplies the valence by -0.74.
* Contrast: tokens before the first contrast word of the text count half,
  those after it one and a half times.
* ``!`` (up to 4) and ``?`` (2 and more) push the sum away from 0, and add to
  the larger of the positive and the negative part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import MAX_BROADCAST_ROWS, checked_broadcast, cut_lineage, key_filter
from .scoring import BOOST_DECAY, NEGATION_SCALAR, NORMALIZE_ALPHA, _lit_map, _neighbours

# Fixed values (rule constants from Hutto & Gilbert, ICWSM 2014):
CAPS_PUSH = 0.733               # a word in capitals
CONTRAST = (0.5, 1.5)           # weight before and after a contrast word
EXCLAIM = (0.292, 4)            # a mark's push, and how many count
QUESTION = (0.18, 3, 0.96)      # push of each of 2 or 3 marks, push of more

_TOKENS = "[\\p{L}\\p{N}]+|[.,;:!?\\n]"
_MARK = "^[.,;:!?\\n]$"
_CAPITALS = "^[\\p{Lu}\\p{N}]*\\p{Lu}[\\p{Lu}\\p{N}]*$"

# copies of a table that is joined through a shuffle: the tokens of a very
# common word go to so many tasks
TABLE_COPIES = 16


def _lookup(rows: DataFrame, table: DataFrame, key: str, value: str, max_rows: int) -> DataFrame:
    """``rows`` with ``value`` of ``table`` (key, value), null where there is
    none: broadcast after a check, else a shuffle join in which a common key
    is dealt to several tasks."""
    small, _ = checked_broadcast(table, max_rows)
    return rows.join(small, key, "left") if small is not None else _shuffled(rows, table, key)


def _shuffled(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    copies = table.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(TABLE_COPIES - 1))))
    h = F.xxhash64("__row", "pos")
    # rows without a key match no copy, and go to any task
    own = F.when(F.col(key).isNull(), -1 - F.pmod(h, F.lit(1 << 30))).otherwise(F.pmod(h, F.lit(TABLE_COPIES))).cast("int")
    return rows.withColumn("__copy", own).join(copies, [key, "__copy"], "left").drop("__copy")


def _once(rows: DataFrame) -> DataFrame:
    """``rows`` with its columns computed at this point, once each: later uses
    of a column don't repeat its expression."""
    cells = F.array(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
    return rows.select(F.inline(cells))


def _head_and_tail(lexicon: DataFrame, common: bool, max_rows: int) -> tuple[DataFrame | None, DataFrame | None]:
    """The part of ``lexicon`` (lt, v1, n) to broadcast and the part to meet
    through a shuffle: all of it and nothing if it is small; else its most
    common terms, if their n is known, and the others."""
    small, _ = checked_broadcast(lexicon.drop("n"), max_rows)
    if small is not None:
        return small, None
    if not common:
        return None, lexicon.drop("n")
    head = cut_lineage(lexicon.orderBy(F.col("n").desc_nulls_last(), "lt").limit(max_rows).drop("n"))
    small, _ = checked_broadcast(head, max_rows)
    if small is None:       # few rows, long terms
        return None, lexicon.drop("n")
    return small, cut_lineage(lexicon.drop("n").join(head.select("lt"), "lt", "left_anti"))


def _capitals(token: str) -> Column:
    return F.coalesce((F.length(token) > 1) & F.col(token).rlike(_CAPITALS), F.lit(False))


def clause_tokens(rows: DataFrame, own: list[str], text_col: str, contrasts: list[str]) -> DataFrame:
    """One row per token of a text: the columns ``own``, pos (place among
    tokens and marks), t (as written), p1, p2, p3 (the tokens before it in
    its clause, else null), and of the text: words (how many tokens), mixed
    (some tokens in capitals, not all), turn (place of the first contrast
    word, null without one). A text that begins with a mark (pos 1), or has no
    token (pos null), has a row without t."""
    toks = rows.select(*own, F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(_TOKENS), 0).alias("toks"))
    words = F.size(F.filter("toks", lambda t: ~t.rlike(_MARK)))
    loud = F.size(F.filter("toks", lambda t: (F.length(t) > 1) & t.rlike(_CAPITALS)))
    places = [F.nullif(F.array_position(F.col("low"), w), F.lit(0)) for w in contrasts]
    turn = F.least(*places, F.lit(None).cast("long")) if places else F.lit(None).cast("long")
    toks = toks.withColumn("low", F.transform("toks", F.lower))
    # what is of the whole text is computed before the explode, once
    toks = toks.select(*own, words.alias("words"), ((loud > 0) & (loud < words)).alias("mixed"), turn.alias("turn"),
                       _neighbours(F.col("toks")).alias("cells"))
    out = toks.select(*own, "words", "mixed", "turn", F.posexplode_outer("cells").alias("at", "c"))
    mark = F.col("c.t").rlike(_MARK)
    out = out.where(F.col("c.t").isNull() | ~mark | (F.col("at") == 0))
    # a mark before a token ends its neighbourhood
    alive, before = F.lit(True), []
    for k in (1, 2, 3):
        alive = alive & F.col(f"c.p{k}").isNotNull() & ~F.col(f"c.p{k}").rlike(_MARK)
        before.append(F.when(alive, F.col(f"c.p{k}")).alias(f"p{k}"))
    return out.select(*own, "words", "mixed", "turn", (F.col("at") + 1).alias("pos"), F.when(~mark, F.col("c.t")).alias("t"), *before)


def sentiment_rules(docs: DataFrame, lexicon: DataFrame, idioms: DataFrame | None = None, id_col: str = "doc_id",
                    text_col: str = "text", negations: list[str] | None = None, boosters: dict | None = None,
                    contrasts: list[str] | None = None, max_broadcast_rows: int = MAX_BROADCAST_ROWS,
                    count_col: str | None = None) -> DataFrame:
    """``(id, neg, neu, pos, compound)``, one row per row of ``docs``, by the
    rules above.

    ``lexicon`` is (term, valence) and ``idioms`` (phrase, valence), the
    phrase of two or three lower-cased tokens with one space between; a
    repeated key takes its least valence. Both may have any number of rows.
    ``negations``, ``boosters`` (word to push) and ``contrasts`` are short
    lists of lower-cased words. A text without tokens scores 0 throughout.
    Ids may be null or repeated, every row is answered; other columns are not
    read.

    Plan: tokens, neighbours and what the rules make of them are row-local;
    lookups are broadcast hash joins after a size check; sums are partial
    aggregates per row before a shuffle of one narrow row per text. Past the
    check, the terms with the highest ``count_col`` of the lexicon (without
    it none) are still broadcast, and tokens meet the others through a
    shuffle: only those that a filter of these terms lets pass, without their
    neighbours; the other tokens of a text are one row by then."""
    boost = _lit_map(boosters or {})
    negs = F.array(*[F.lit(w) for w in negations or []]).cast("array<string>")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    marks = [(F.length(text) - F.length(F.replace(text, F.lit(m)))).alias(c) for m, c in (("!", "ex"), ("?", "qu"))]
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(f"`{id_col}`").alias("id"), *marks, text.alias("text"))
    own = ["__row", "id", "ex", "qu"]       # sums are per row, so rows that repeat an id are answered each
    toks = clause_tokens(rows, own, "text", contrasts or []).withColumn("lt", F.lower("t"))
    for p in ("p1", "p2", "p3"):
        toks = toks.withColumn(f"l{p}", F.lower(p))
    # what is of the text goes with one of its rows, its head
    of_text = ["id", "ex", "qu", "words"]
    toks = toks.withColumn("head", F.coalesce(F.col("pos") == 1, F.lit(True)))
    toks = toks.select(*[c for c in toks.columns if c not in of_text], *[F.when(F.col("head"), F.col(c)).alias(c) for c in of_text])

    def table(df, key, value):
        return df.select(F.col(df.columns[0]).alias(key), F.col(df.columns[1]).cast("double").alias(value)).where(
            F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias(value))

    idiom = F.lit(None).cast("double")
    if idioms is not None:
        g2, g3 = F.concat_ws(" ", "lp1", "lt"), F.concat_ws(" ", "lp2", "lp1", "lt")
        toks = toks.withColumn("g2", F.when(F.col("lp1").isNotNull(), g2)).withColumn("g3", F.when(F.col("lp2").isNotNull(), g3))
        toks = _lookup(toks, table(idioms, "g2", "v2"), "g2", "v2", max_broadcast_rows)
        toks = _lookup(toks, table(idioms, "g3", "v3"), "g3", "v3", max_broadcast_rows)
        idiom = F.coalesce("v3", "v2")
    loud = F.when(F.col("mixed") & _capitals("t"), F.lit(CAPS_PUSH)).otherwise(0.0)
    push = F.lit(0.0)
    for k, decay in enumerate(BOOST_DECAY, 1):
        b = F.try_element_at(boost, F.col(f"lp{k}"))
        b = b + F.when(F.col("mixed") & _capitals(f"p{k}"), F.signum(b) * CAPS_PUSH).otherwise(0.0)
        push = push + F.coalesce(b, F.lit(0.0)) * decay
    denied = F.lit(False)
    for k in (1, 2, 3):
        denied = denied | F.coalesce(F.array_contains(negs, F.col(f"lp{k}")), F.lit(False))
    weight = F.when(F.col("pos") < F.col("turn"), CONTRAST[0]).when(F.col("pos") > F.col("turn"), CONTRAST[1]).otherwise(1.0)

    def value(v0):
        sign = F.signum(v0)
        x = v0 + sign * F.col("loud") + sign * F.col("push")
        x = F.when(F.col("denied"), x * NEGATION_SCALAR).otherwise(x) * F.col("weight")
        return F.when(v0 == 0, F.lit(0.0)).otherwise(x)

    counts = F.lit(None).cast("long") if count_col is None else F.max(F.col(f"`{count_col}`")).cast("long")
    terms = lexicon.select("*", F.col(lexicon.columns[0]).alias("__lt"), F.col(lexicon.columns[1]).cast("double").alias("__v1"))
    terms = terms.where("__lt is not null").groupBy(F.col("__lt").alias("lt")).agg(F.min("__v1").alias("v1"), counts.alias("n"))
    common, others = _head_and_tail(terms, count_col is not None, max_broadcast_rows)
    toks = toks.withColumn("idiom", idiom)
    toks = toks.join(common, "lt", "left") if common is not None else toks.withColumn("v1", F.lit(None).cast("double"))
    # each token is a term of its own for the rest of the lexicon, or has its
    # value now and is summed with those of its text, before any shuffle
    late = F.lit(False)
    if others is not None:
        late = F.col("idiom").isNull() & F.col("v1").isNull() & F.col("lt").isNotNull() & key_filter(others, "lt")(F.col("lt"))
    # the rules are for tokens that have a valence or may have one
    toks = toks.withColumn("late", late).where("late or idiom != 0 or v1 != 0 or head")
    cells = _once(toks.select("__row", *of_text, "head", "lt", "pos", "idiom", "v1", "late", loud.alias("loud"), push.alias("push"),
                              denied.alias("denied"), weight.alias("weight")))
    x = F.when(F.col("late"), F.lit(0.0)).otherwise(value(F.coalesce("idiom", "v1", F.lit(0.0))))
    own = ["lt", "pos", "loud", "push", "denied", "weight"] if others is not None else []
    cells = cells.select("__row", *of_text, "head", x.alias("x"), "late", *[F.when(F.col("late"), F.col(c)).alias(c) for c in own])
    # all but the id are numbers, which a hash table sums in place
    text_of = [F.first("id", ignorenulls=True).alias("id"), *[F.max(c).alias(c) for c in of_text[1:]]]
    j = cells.where("late or x != 0 or head").groupBy("__row", *own).agg(
        *text_of, F.sum("x").alias("s"),
        F.sum(F.when(F.col("x") > 0, F.col("x") + 1).otherwise(0.0)).alias("ps"),
        F.sum(F.when(F.col("x") < 0, 1 - F.col("x")).otherwise(0.0)).alias("ns"),
        F.count(F.when(F.col("x") != 0, 1)).alias("hits"))
    if others is not None:
        j = _shuffled(j, others, "lt").withColumn("y", F.when(F.col("v1").isNull(), 0.0).otherwise(value(F.col("v1"))))
        j = j.groupBy("__row").agg(
            *text_of, F.sum(F.col("s") + F.col("y")).alias("s"),
            F.sum(F.col("ps") + F.when(F.col("y") > 0, F.col("y") + 1).otherwise(0.0)).alias("ps"),
            F.sum(F.col("ns") + F.when(F.col("y") < 0, 1 - F.col("y")).otherwise(0.0)).alias("ns"),
            F.sum(F.col("hits") + F.when(F.col("y") != 0, 1).otherwise(0)).alias("hits"))
    j = j.select("id", "ex", "qu", "s", "ps", "ns", (F.col("words") - F.col("hits")).cast("double").alias("nu"))
    stress = F.least("ex", F.lit(EXCLAIM[1])) * EXCLAIM[0] + F.when(F.col("qu") > QUESTION[1], F.lit(QUESTION[2])).when(
        F.col("qu") > 1, F.col("qu") * QUESTION[0]).otherwise(0.0)
    zero = F.lit(0.0)
    j = j.withColumn("e", stress)
    s = F.col("s") + F.signum("s") * F.col("e")
    ps = F.col("ps") + F.when(F.col("ps") > F.col("ns"), F.col("e")).otherwise(0.0)
    ns = F.col("ns") + F.when(F.col("ns") > F.col("ps"), F.col("e")).otherwise(0.0)
    j = j.select("id", s.alias("s"), ps.alias("ps"), ns.alias("ns"), "nu")
    total = F.col("ps") + F.col("ns") + F.col("nu")
    share = lambda c: F.when(total > 0, F.col(c) / total).otherwise(zero)
    return j.select(F.col("id").alias(id_col), share("ns").alias("neg"), share("nu").alias("neu"), share("ps").alias("pos"),
                    (F.col("s") / F.sqrt(F.col("s") * F.col("s") + F.lit(NORMALIZE_ALPHA))).alias("compound"))


def label_lexicon(docs: DataFrame, label_col: str, text_col: str = "text", min_texts: int = 3, least: float = 0.5) -> DataFrame:
    """(term, valence, n_texts) from labelled texts: ``label_col`` is 1 for good and 0
    for other texts. The valence of a token is 4 (g - b) / (g + b), g and b
    the shares of the good and the other texts that have it; tokens of fewer
    than ``min_texts`` texts (``n_texts``) and valences below ``least`` are left out."""
    known = docs.where(F.col(label_col).isin(0, 1))
    tok = F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text_col, F.lit(""))), F.lit("[\\p{L}\\p{N}]+"), 0)))
    total = known.agg(F.count(F.when(F.col(label_col) == 1, 1)).alias("n_good"), F.count(F.when(F.col(label_col) == 0, 1)).alias("n_bad"))
    words = known.select(F.col(label_col).alias("c"), tok.alias("term")).groupBy("term").agg(
        F.count(F.when(F.col("c") == 1, 1)).alias("good"), F.count(F.when(F.col("c") == 0, 1)).alias("bad"))
    g, b = F.col("good").cast("double") / F.col("n_good"), F.col("bad").cast("double") / F.col("n_bad")
    out = words.where(F.col("good") + F.col("bad") >= min_texts).join(F.broadcast(total)).where("n_good > 0 and n_bad > 0")
    return out.select("term", ((g - b) / (g + b) * 4).alias("valence"), (F.col("good") + F.col("bad")).alias("n_texts")).where(F.abs("valence") >= least)
