"""Secret scans: single patterns, and multipart credentials linked by an interval join."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import left_on_row, texts


@dataclass(frozen=True)
class Pattern:
    """kind: name of its spans; regex: Java syntax; group and least: matches whose group has fewer
    code points are dropped; also: what the whole match must contain, too; some: a text with none of these has no match."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1
    also: tuple[str, ...] = ()
    some: tuple[str, ...] = ()


#: Either case of the keywords by classes, so that no Unicode folding is involved.
_ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_LOGIN = r"""([uU][sS][eE][rR]([nN][aA][mM][eE])?|[lL][oO][gG][iI][nN]|[cC][lL][iI][eE][nN][tT]_?[iI][dD]|[aA][cC][cC][oO][uU][nN][tT])["']?\x20*[:=]\x20*["']?[A-Za-z0-9@_.-]+"""
_ENDPOINT = r"""[a-z][a-z0-9+]*://[A-Za-z0-9._~:/?#@%&=+-]+|[hH][oO][sS][tT]["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.:-]+|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"""

#: A run of hex digits of 24 or more, and AKIA with 16 or more, are found as such: matches are whole
#: runs, so a shorter one can't hide a longer one, and most texts yield no match to size.
#: Reported wherever they stand. In this order where spans start together.
BASE = (
    Pattern("assign", _ASSIGN, 2, 6, some=(":", "=")),
    Pattern("access", "AKIA[A-Z0-9]{16,}", 0, 20, some=("AKIA",)),
    Pattern("hex", "[0-9a-f]{24,}", 0, 24),
)
#: Too common alone; reported only where the complementary parts stand within the scope.
WEAK = (
    Pattern("login", _LOGIN, some=(":", "=")),
    Pattern("blob", "[A-Za-z0-9+/]{40,}", also=("[A-Z]", "[a-z]", "[0-9]")),
    Pattern("endpoint", _ENDPOINT),
)
ROLES = {"access": "identifier", "login": "identifier", "assign": "secret", "hex": "secret", "blob": "secret", "endpoint": "endpoint"}
KINDS = [p.kind for p in (*BASE, *WEAK)]


def _matches(text: Column, p: Pattern) -> Column:
    """Leftmost non-overlapping matches with what precedes each: gap and len in code points.
    The pieces between matches come from ``split`` with the same pattern."""
    re, none = F.lit(p.regex), F.array().cast("array<struct<kind:int,ord:int,gap:int,len:int,ok:boolean>>")
    found = F.regexp_extract_all(text, re, F.lit(0))

    def one(x: Column, i: Column) -> Column:
        ok = F.length(F.get(F.regexp_extract_all(text, re, F.lit(p.group)), i) if p.group else x) >= p.least
        for also in p.also:
            ok = ok & x.rlike(also)
        return F.struct(F.lit(KINDS.index(p.kind)).alias("kind"), i.alias("ord"), F.length(F.get(F.split(text, p.regex, -1), i)).alias("gap"), F.length(x).alias("len"), ok.alias("ok"))

    # a match is looked for first, and before it what it can't do without: most texts have none
    may = reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in p.some]) & text.rlike(p.regex) if p.some else text.rlike(p.regex)
    return F.when(may, F.transform(found, one)).otherwise(none)


def find_secrets(docs: DataFrame, scope: int = 300, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets: the base kinds assign, access and hex wherever they stand, and of the weak
    kinds login, blob and endpoint those that complete a credential. Parts of one credential lie
    within ``scope`` code points of each other: a blob needs an identifier (access, login) or an
    endpoint there; a login needs a secret (assign, hex, blob); an endpoint needs an identifier and a
    secret. A weak span that overlaps a base span isn't reported.

    Returns one row for each row of ``docs``: doc_id, spans (array of kind, start, end in code points,
    end exclusive, by start and then in the order of kinds, and linked: of each other role - identifier, secret, endpoint - the part that
    stands nearest within the scope, as role, kind, start, end). A null or empty text has none; where rows
    repeat a doc_id and a text they share the spans. An empty table gives an empty result; other columns are ignored.

    The join is an interval join by sorted order: for every part the nearest one of each role on
    either side is carried along by window functions over the parts of one text, so nothing is
    compared in pairs. Only texts with a match are exploded, and no text is shuffled.
    """
    base = texts(docs, id_col, text_col)
    any_match = F.array(*[_matches(F.col("text"), p) for p in (*BASE, *WEAK)])
    each = base.select("doc_id", "_th", F.explode(F.flatten(any_match)).alias("m")).select("doc_id", "_th", "m.*").distinct()
    order = Window.partitionBy("doc_id", "_th", "kind").orderBy("ord")
    end = F.sum(F.col("gap") + F.col("len")).over(order)
    parts = each.select("doc_id", "_th", "kind", "ok", (end - F.col("len")).cast("int").alias("start"), end.cast("int").alias("end")).where("ok")
    role = F.element_at(F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(i), F.lit(ROLES[k]))]), F.col("kind"))
    parts = parts.withColumn("role", role).withColumn("weak", F.col("kind") >= len(BASE))
    line = Window.partitionBy("doc_id", "_th").orderBy("start", "end", "kind")
    before, after = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(1, Window.unboundedFollowing)
    hit = (F.max(F.when(~F.col("weak"), F.col("end"))).over(before) > F.col("start")) | (F.min(F.when(~F.col("weak"), F.col("start"))).over(after) < F.col("end"))
    parts = parts.withColumn("hit", F.coalesce(hit, F.lit(False))).where("not (weak and hit)")

    def near(role: str) -> Column:
        """The nearest other part of the role within the scope, the earlier one of two."""
        of = F.col("role") == role
        left = F.max(F.when(of, F.struct("end", "start", "kind"))).over(before)
        right = F.min(F.when(of, F.struct("start", "end", "kind"))).over(after)
        left_by, right_by = F.col("start") - left["end"], right["start"] - F.col("end")
        part = lambda x: F.struct(F.lit(role).alias("role"), F.get(names, x["kind"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
        first = (left_by <= scope) & (right_by.isNull() | (left_by <= right_by))
        return F.when(first, part(left)).when(right_by <= scope, part(right))

    names = F.array(*[F.lit(k) for k in KINDS])
    roles = ("identifier", "secret", "endpoint")
    parts = parts.withColumns({r: near(r) for r in roles})
    have = {r: F.col(r).isNotNull() for r in roles}
    needs = {"login": have["secret"], "blob": have["identifier"] | have["endpoint"], "endpoint": have["identifier"] & have["secret"]}
    kept = ~F.col("weak")
    for k, need in needs.items():
        kept = kept | ((F.col("kind") == KINDS.index(k)) & need)
    linked = F.filter(F.array(*[F.when(F.col("role") != r, F.col(r)) for r in roles]), lambda x: x.isNotNull())
    spans = parts.where(kept).groupBy("doc_id", "_th").agg(F.array_sort(F.collect_list(F.struct("start", F.col("kind").alias("k"), "end", linked.alias("linked")))).alias("found"))
    out = left_on_row(base.select("doc_id", "_th"), spans)
    shown = F.transform("found", lambda x: F.struct(F.get(names, x["k"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["linked"].alias("linked")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,linked:array<struct<role:string,kind:string,start:int,end:int>>>>")
    return out.select("doc_id", F.coalesce(shown, none).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined in order."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
