"""Redaction, and the check that nothing forbidden is left."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroudspark.config import Settings
from shroudspark.functions import spans
from shroudspark.functions.literals import Literals
from shroudspark.functions.text import ESCAPE, canonicalize, folded, forbidden_forms, normalize_ws, unfolded_part
from shroudspark.operators.detect import with_spans


def redact(df: DataFrame, text_col: str = "text", settings: Settings = Settings(), known=None, model=None) -> DataFrame:
    """``df`` with every span of the text replaced by ``<TYPE>``; texts without one are unchanged."""
    text = F.col(f"`{text_col}`")
    found = with_spans(df, f"`{text_col}`", settings, model, "__spans")
    if known is not None:
        found = found.withColumn("__spans", F.concat("__spans", F.coalesce(known(text), F.expr(spans.NO_SPANS))))
    # Generated, not projected: filters on the text aren't pushed through and planned with all detectors again.
    masked = F.inline(F.array(F.struct(spans.mask(text, F.col("__spans")).alias(text_col))))
    return found.select(*(F.col(f"`{c}`") for c in df.columns if c != text_col), masked).select(*(F.col(f"`{c}`") for c in df.columns))


def forms(terms: DataFrame, term_col: str = "term") -> DataFrame:
    """Distinct forbidden forms of terms, as one column ``form``."""
    return terms.select(F.explode(forbidden_forms(F.col(term_col))).alias("form")).distinct()


def leaks(text: Column, form: Column) -> Column:
    return F.contains(F.lower(normalize_ws(text)), form) | F.contains(canonicalize(text), form)


def flagged(df: DataFrame, terms: DataFrame, text_col: str = "text", term_col: str = "term", most_broadcast: int = 8 << 20, out: str = "leaks") -> DataFrame:
    """``df`` with a column ``out``: whether the text gives a term away, that is, a form is part of one of its normal forms.

    The forms' size is looked up first.  Up to ``most_broadcast`` bytes they are sent to
    every executor, where a pass over a text looks for all of them at once.  Words are
    folded, and a second pass made, only where that can matter: in texts that hold the
    unfolded part of a form with a word that folding makes.  Beyond it the two sides meet on pieces: a form can be
    part of a text only if the text holds the form's first four characters.  Pieces go
    with fingerprints of the texts, not with the texts, which meet the forms that they
    may hold once.  Forms of fewer characters are no more than there are such strings.
    """
    listed = forms(terms, term_col)
    size = listed.agg(F.sum(F.octet_length("form"))).first()[0] or 0
    text = F.col(f"`{text_col}`")
    kept = [F.col(f"`{c}`") for c in df.columns]
    prepared = df.withColumn("__norm", F.lower(normalize_ws(text)))
    if size <= most_broadcast:
        sought = [r["form"] for r in listed.collect()]
        first, second = _seekers(sought)
        norm, state = F.col("__norm"), F.col("__state")
        # Generated, not projected: otherwise the normal form is worked out again for the canonical one.
        prepared = df.select(*kept, F.inline(F.array(F.struct(F.lower(normalize_ws(text)).alias("__norm")))))
        once = prepared.select(*kept, norm, first(norm).alias("__state"))
        twice = once.select(*kept, state, F.when(state == _MAY_HOLD, folded(norm)).alias("__canon"))
        return twice.select(*kept, ((state == _HOLDS) | second("__canon")).alias(out))
    prepared = prepared.withColumn("__canon", F.coalesce(folded(F.col("__norm")), "__norm"))
    holds = lambda form: F.contains(F.col("__norm"), form) | F.contains(F.col("__canon"), form)
    width = 4
    long, few = F.length("form") >= width, listed.filter(F.length("form") < width)
    texts = prepared.filter(text.isNotNull()).select("__norm", "__canon").withColumns({"__h1": F.xxhash64("__norm", "__canon"), "__h2": F.xxhash64(F.lit(1), "__norm", "__canon")}).distinct()
    cut = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - width + 1, F.lit(1))), lambda k: F.substring(F.col(c), k, F.lit(width)))
    pieces = texts.select("__h1", "__h2", F.explode_outer(F.array_union(cut("__norm"), cut("__canon"))).alias("__piece"))
    may = pieces.join(listed.filter(long).withColumn("__piece", F.substring("form", 1, width)), "__piece").select("__h1", "__h2", "form").distinct()
    met = texts.join(may, ["__h1", "__h2"]).filter(holds(F.col("form"))).select("__norm", "__canon")
    short = F.broadcast(few.agg(F.collect_list("form").alias("__forms")))
    tiny = texts.crossJoin(short).filter(F.exists("__forms", holds)).select("__norm", "__canon")
    hit = met.union(tiny).distinct().withColumn("__hit", F.lit(True))
    return prepared.join(hit, ["__norm", "__canon"], "left").select(*kept, F.coalesce("__hit", F.lit(False)).alias(out))


_HOLDS_NOT, _HOLDS, _MAY_HOLD = 0, 1, 2


def _seekers(sought: list[str]):
    """Two functions of texts: whether a normal form holds one of the strings, or its canonical form may; and whether a canonical form, or null, holds one."""
    parts = {unfolded_part(s) for s in sought} - {None}
    whole, some, every = Literals(sought), Literals(parts), "" in parts

    @F.arrow_udf("int")
    def first(norm: pa.Array) -> pa.Array:
        may = np.ones(len(norm), bool) if every else some.held(norm) | pc.match_substring(norm, ESCAPE).fill_null(False).to_numpy(False)
        return pa.array(np.where(whole.held(norm), _HOLDS, np.where(may, _MAY_HOLD, _HOLDS_NOT)), pa.int32())

    @F.arrow_udf("boolean")
    def second(canon: pa.Array) -> pa.Array:
        return pa.array(whole.held(canon))

    return first, second


def leaking(df: DataFrame, terms: DataFrame, text_col: str = "text", term_col: str = "term", most_broadcast: int = 8 << 20) -> DataFrame:
    """Rows of ``df`` whose text gives a term away (``flagged``)."""
    return flagged(df, terms, text_col, term_col, most_broadcast, "__leaks").filter("__leaks").drop("__leaks")


def value_free(df: DataFrame, terms: DataFrame, text_col: str = "text", term_col: str = "term") -> DataFrame:
    """One row: ``value_free``, whether no text gives a term away; true without terms."""
    found = leaking(df, terms, text_col, term_col).agg(F.count("*").alias("n"))
    return found.select((F.col("n") == 0).alias("value_free"))
