"""Parties against a ledger (V8): exact by name, alias or mailing name, else the closest entry within some edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stored import stored

#: Names of an entry in their order of preference.
KINDS = ["ledger_name", "alias", "mailing_name"]
#: Names up to this length are compared by shortened strings, longer ones by parts.
SHORT = 40
#: Columns of the result, which replace those of the same name.
FOUND = ["key", "matched_by", "closest", "distance", "warning"]


def _plain(name: Column) -> Column:
    return F.upper(F.trim(name))


def _shortened(texts: Column, times: int) -> Column:
    """Distinct strings that arise from leaving out up to ``times`` characters."""
    for _ in range(times):
        one = lambda s: F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))).otherwise(F.array(s))
        texts = F.array_distinct(F.concat(texts, F.flatten(F.transform(texts, one))))
    return texts


def _parts(text: Column, edits: int, probe: bool) -> Column:
    """Hashes of the ``edits`` + 1 equal parts of a text, or of all places where such a part of a near text may stand."""
    n = F.length(text)
    begin = lambda i, size: F.floor(size * i / (edits + 1)).cast("int")
    cut = lambda i, size, shift: F.xxhash64(F.lit(i), size, F.substring(text, begin(i, size) + 1 + shift, begin(i + 1, size) - begin(i, size)))
    about = range(-edits, edits + 1)
    if probe:
        return F.array_distinct(F.array(*[cut(i, n + d, shift) for i in range(edits + 1) for d in about for shift in about]))
    return F.array(*[cut(i, n, 0) for i in range(edits + 1)])


def _near(names: DataFrame, forms: DataFrame, edits: int) -> DataFrame:
    """The closest form of each of ``names(_u)`` within ``edits``: ``(_u, _best)``.

    Two strings within some edits share a string that both become by leaving out that many characters, so they meet
    there: about n ** edits / edits! strings for n characters. Names above ``SHORT`` meet by parts instead: of
    ``edits`` + 1 equal parts of a text, a near text has one whole, moved by at most ``edits``. Who meets is measured.
    """
    spread = lambda t, keys: t.withColumn("_v", F.explode(keys))
    hashed = lambda text: F.transform(_shortened(F.array(text), edits), lambda s: F.xxhash64(s))
    n, m = F.length("_u"), F.length("form")
    met = spread(names.where(n <= SHORT), hashed(F.col("_u"))).hint("merge").join(spread(forms.where(m <= SHORT + edits), hashed(F.col("form"))).hint("merge"), "_v")
    probes = spread(names.where(n > SHORT), _parts(F.col("_u"), edits, True))
    met = met.unionByName(probes.hint("merge").join(spread(forms.where(m > SHORT - edits), _parts(F.col("form"), edits, False)).hint("merge"), "_v"))
    far = met.withColumn("_d", F.levenshtein("_u", "form", edits)).where("_d >= 0")
    return far.groupBy("_u").agg(F.min(F.struct(F.col("_d").alias("distance"), "form", "key", "kind")).alias("_best"))


def closest_parties(names: DataFrame, ledger: DataFrame, edits: int = 2) -> DataFrame:
    """V8: rows of ``names(name, ...)`` with ``key``, ``matched_by``, ``closest``, ``distance`` and ``warning``.

    ``ledger(key, ledger_name, alias, mailing_name)``. A name that equals one of an entry, whatever case and outer
    spaces, has its key and no warning (ties: order of the kinds, then the least key). Any other name has the closest
    form within ``edits`` (ties: form, then key) or none. Null and blank names match nothing and have no warning; null
    and blank forms are left out. Repeated names are looked up once. Names are measured edit by edit, so only those
    without an entry at one distance go on to the next. Own columns named as one of ``FOUND`` are replaced.
    """
    kind = F.posexplode(F.array(*[_plain(F.col(k)) for k in KINDS])).alias("kind", "form")
    forms = ledger.select("key", kind).where("form <> ''")
    forms = stored(forms.groupBy("form").agg(F.min(F.struct("kind", "key")).alias("_f")).select("form", "_f.key", "_f.kind"))
    told = names.withColumn("_u", _plain(F.col("name")))
    own = told.select("_u").where("_u <> ''").distinct()
    exact = own.hint("merge").join(forms.hint("merge"), F.col("_u") == F.col("form"), "left")
    exact = stored(exact.select("_u", F.when(F.col("form").isNotNull(), F.struct(F.lit(0).alias("distance"), "form", "key", "kind")).alias("_best")))
    found, left = [exact.where("_best IS NOT NULL")], exact.where("_best IS NULL").select("_u")
    for distance in range(1, edits + 1):
        near = stored(_near(left, forms, distance))
        found.append(near)
        left = left.hint("merge").join(near.hint("merge"), "_u", "left_anti")
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    rows = told.hint("merge").join(best.hint("merge"), "_u", "left")
    equal, distance = F.col("_best.distance") == 0, F.col("_best.distance")
    warning = F.when(F.col("_u") == "", None).when(distance.isNull() & F.col("_u").isNotNull(), "Party not found in ledgers").when(distance > 0, F.concat(F.lit("No exact match; closest: "), "_best.form"))
    return rows.select(
        *[c for c in names.columns if c not in FOUND], F.when(equal, F.col("_best.key")).alias("key"), F.when(equal, F.get(F.array(*map(F.lit, KINDS)), F.col("_best.kind"))).alias("matched_by"),
        F.col("_best.form").alias("closest"), distance.alias("distance"), warning.alias("warning"),
    )
