"""One label for each candidate; the first rule that holds decides."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from semspark.functions import arrays as A
from semspark.functions import text as X

MIN_WORDS, MAX_WORDS = 2, 8
COPY_THRESHOLD, MARGIN = 0.94, 0.0
NEAR, FAR = 0.9, 0.55


def counted(candidates: Column) -> Column:
    """An array of texts as one of (ordinal from 1, candidate, copies), in its order.

    ``copies`` is how many of the array are equal when case is folded.  The array is
    sorted once and its runs measured, with no shuffle and no state, so that it holds for
    tables and streams alike and a completion of a hundred thousand lines is no burden.
    """
    entries = F.transform(candidates, lambda c, i: F.struct(F.lower(c).alias("low"), (i + 1).alias("ordinal"), c.alias("candidate")))
    entry = lambda e, n: F.struct(e["ordinal"].alias("ordinal"), e["candidate"].alias("candidate"), n.alias("copies"))
    of_run = lambda v, at, n: F.transform(A.span(at, n), lambda j: entry(F.get(v, j), n))
    return F.sort_array(F.flatten(A.runs(F.sort_array(entries), lambda e: e["low"], of_run)))


def reason_base(candidate: Column, copies: Column, current: Column, target: Column | None, min_words: int = MIN_WORDS, max_words: int = MAX_WORDS) -> Column:
    low = F.lower(candidate)
    out = F.when(A.let(X.word_count(candidate), lambda n: (n < min_words) | (n > max_words)), "invalid_length").when(low == F.lower(current), "literal_copy_current")
    if target is not None:
        out = out.when((F.coalesce(target, F.lit("")) != "") & (low == F.lower(target)), "literal_copy_target")
    return out.when(copies > 1, "duplicate_output").otherwise("valid")


def reason_influence(base: Column, similarity: Column, improvement: Column, copy: float = COPY_THRESHOLD, margin: float = MARGIN) -> Column:
    progress = F.when(similarity >= copy, "semantic_copy_target").when(improvement > margin, "valid").otherwise("insufficient_semantic_progress")
    return F.when(base != "valid", base).otherwise(progress)


def reason_turbulence(base: Column, similarity: Column, far: float = FAR, near: float = NEAR) -> Column:
    span = F.when(similarity < far, "too_distant_from_current").when(similarity > near, "too_close_to_current").otherwise("valid")
    return F.when(base != "valid", base).otherwise(span)


def is_valid(reason: Column) -> Column:
    return reason == "valid"
