"""Secret scans with multipart credential linking, in DataFrame functions only.

Base spans (assign, access, hex) stand by themselves. Weak parts are pieces that mean little alone: an
account name or address (role id), a short or loosely named password (role secret), a host or URL (role
endpoint). They are reported when complementary parts lie in the same scope, that is when they start at
most SCOPE code points apart: an id with a secret, a secret with an id, an endpoint with both. Base spans
count as parts too (access as id, assign and hex as secret), but are never reported twice.

Positions: a text is split by the pattern and the lengths of gaps and matches are summed up in the row, in
blocks, so that a text with very many matches costs no more than its length and their number.
The interval join works on bins of SCOPE code points: each bin keeps the first and last start of each
role, and a weak part asks its own bin and both neighbours. So a document with very many parts costs a row
for each part, never a row for each pair.

Nulls and odd input: a null or empty text has no spans; equal rows get equal results (they share a key);
null ids are kept; an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import bound, materialise, row_key, running

SCOPE = 256


@dataclass(frozen=True)
class Pattern:
    """A kind of span: its pattern, the group whose length counts and that length's limits, the part's role.

    `guard` is true of every text that has a match, and so is one of `signs`; other texts aren't split.
    """

    kind: str
    role: str
    regex: str
    group: int = 0
    least: int = 1
    most: int | None = None
    weak: bool = False
    guard: str = ""
    signs: tuple[str, ...] = ()


_SET = r"""["']?\x20*[:=]\x20*["']?"""
_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ASSIGN_GUARD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
PATTERNS = (
    Pattern("assign", "secret", _ASSIGN, 2, 8, guard=_ASSIGN_GUARD, signs=(":", "=")),
    Pattern("access", "id", "AKIA[A-Z0-9]+", 0, 16, guard="AKIA", signs=("AKIA",)),
    Pattern("hex", "secret", "[0-9a-f]{32,}", guard="[0-9a-f]{32}"),
    Pattern("weak_id", "id", rf"(?i:user(?:name)?|login|account|client_?id|key_?id){_SET}[A-Za-z0-9._@+-]{{3,}}", weak=True, guard=r"""(?i:user|name|login|account|_?id)["']?\x20*[:=]""", signs=(":", "=")),
    Pattern("weak_contact", "id", r"[A-Za-z0-9._+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}", weak=True, guard=r"[A-Za-z0-9._+-]@[A-Za-z0-9-]", signs=("@",)),
    Pattern("weak_assign", "secret", _ASSIGN, 2, 4, 7, weak=True, guard=_ASSIGN_GUARD, signs=(":", "=")),
    Pattern("weak_secret", "secret", rf"(?i:pass|pwd|auth|credential|private_?key|signature){_SET}[A-Za-z0-9+/_.=-]{{4,}}", weak=True, guard=r"""(?i:pass|pwd|auth|credential|key|signature)["']?\x20*[:=]""", signs=(":", "=")),
    Pattern("weak_host", "endpoint", rf"(?i:host|endpoint|server){_SET}[A-Za-z0-9.:/_-]{{4,}}", weak=True, guard=r"""(?i:host|endpoint|server)["']?\x20*[:=]""", signs=(":", "=")),
    Pattern("weak_url", "endpoint", r"""[a-z][a-z0-9+.-]{1,15}://[^\x00-\x20"'<>]+""", weak=True, guard="[a-z0-9+.-]://", signs=("://",)),
    Pattern("weak_address", "endpoint", r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?", weak=True, guard=r"[0-9]\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]"),
)
BASE = tuple(p for p in PATTERNS if not p.weak)
WEAK = tuple(p for p in PATTERNS if p.weak)
_SPANS = "array<struct<start:int,end:int>>"
#: Code points that are cut off a text together, so that reaching a place costs no more than that.
CUT = 4096


def spans_of(text: Column, p: Pattern) -> Column:
    """array<struct<start, end>> of the pattern's leftmost non-overlapping matches that pass, in code points.

    The text is split by the pattern; what is before a match is the gaps and matches before it.
    """
    match = lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("len"), (F.length(F.regexp_extract(m, p.regex, p.group)) if p.group else F.length(m)).alias("n"))
    passes = lambda x: (x["n"] >= p.least) & (F.lit(True) if p.most is None else x["n"] <= p.most)

    def placed(pairs: Column) -> Column:
        before = running(F.transform(pairs, lambda x: x["gap"] + x["len"]), lambda a, b: a + b)
        spans = F.zip_with(before, pairs, lambda b, x: F.when(passes(x), F.struct((b + x["gap"]).alias("start"), (b + x["gap"] + x["len"]).alias("end"))))
        return F.filter(spans, lambda x: x.isNotNull())

    cut = lambda found: F.zip_with(F.slice(F.split(text, p.regex, -1), F.lit(1), F.size(found)), found, match)
    slim = bound(bound(F.regexp_extract_all(text, F.lit(p.regex), F.lit(0)), cut), placed)
    likely = text.rlike(p.guard)
    if p.signs:
        likely = reduce(lambda a, b: a | b, [text.contains(x) for x in p.signs]) & likely
    return F.when(likely, slim).otherwise(F.array().cast(_SPANS))


def _labelled(p: Pattern) -> Column:
    kind, at = F.lit(p.kind), F.lit(PATTERNS.index(p))
    return F.transform(F.col(p.kind), lambda x: F.struct(x["start"].alias("start"), at.alias("at"), kind.alias("kind"), x["end"].alias("end")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per document: id, key_a, key_b, base and spans, each array<struct<start, at, kind, end>> in order.

    base: the assign, access and hex spans; spans: those and the linked weak parts. `at` is the kind's
    place in PATTERNS. key_a and key_b are the row's key (see common.row_key).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("id"), *row_key(id_col, text_col), text.alias("text"))
    found = materialise(source.select("id", "key_a", "key_b", *[spans_of(F.col("text"), p).alias(p.kind) for p in PATTERNS]))

    def labelled(patterns) -> Column:
        return F.array_sort(F.concat(*[_labelled(p) for p in patterns]))

    any_weak = sum((F.size(p.kind) for p in WEAK), F.lit(0)) > 0
    role = F.create_map(*[x for p in PATTERNS for x in (F.lit(p.kind), F.lit(p.role))])
    parts = found.where(any_weak).select("key_a", "key_b", F.explode(F.concat(*[_labelled(p) for p in PATTERNS])).alias("s")).select("key_a", "key_b", "s.*").distinct()
    parts = parts.withColumn("role", role[F.col("kind")]).withColumn("bin", F.floor(F.col("start") / scope).cast("int"))
    bins = parts.groupBy("key_a", "key_b", "bin", "role").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    weak = parts.where(F.col("kind").startswith("weak_")).withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    near = weak.alias("w").join(bins.alias("b"), ["key_a", "key_b", "bin"]).where("w.role <> b.role AND b.last >= w.start - %d AND b.first <= w.start + %d" % (scope, scope))
    by = ["key_a", "key_b", "start", "at", "kind", "end", F.col("w.role").alias("own")]
    roles = near.select(*by, F.col("b.role").alias("other")).groupBy("key_a", "key_b", "start", "at", "kind", "end", "own").agg(F.collect_set("other").alias("others"))
    has = lambda r: F.array_contains("others", r)
    linked = roles.where(F.when(F.col("own") == "id", has("secret")).when(F.col("own") == "secret", has("id")).otherwise(has("id") & has("secret")))
    added = linked.groupBy("key_a", "key_b").agg(F.collect_list(F.struct("start", "at", "kind", "end")).alias("added"))
    base = labelled(BASE)
    out = found.select("id", "key_a", "key_b", base.alias("base")).join(added, ["key_a", "key_b"], "left")
    return out.select("id", "key_a", "key_b", "base", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:int,at:int,kind:string,end:int>>")))).alias("spans"))


def rendered(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """The documents with each stretch covered by spans replaced by `mark`; chars_col, if given, is set anew."""
    found = scan(docs, id_col, text_col).where(F.size("spans") > 0).select("key_a", "key_b", "spans").distinct()
    both = docs.select(F.struct("*").alias("doc"), *row_key(id_col, text_col)).join(found, ["key_a", "key_b"], "left")
    text = F.col("doc").getField(text_col)
    # Stretches between spans: from the greatest end so far to the next start, put together from cut pieces.
    both = both.withColumn("cuts", F.when(F.col("spans").isNotNull(), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))))
    both = both.withColumn("ends", running(F.transform("spans", lambda s: s["end"]), F.greatest))
    piece = lambda i: F.coalesce(F.try_element_at("cuts", i + 1), F.lit(""))

    def between(a: Column, b: Column) -> Column:
        i, j = F.floor(a / CUT).cast("int"), F.floor(b / CUT).cast("int")
        tail, middle, head = F.substr(piece(i), a % CUT + 1), F.array_join(F.slice("cuts", i + 2, F.greatest(F.lit(0), j - i - 1)), ""), F.substr(piece(j), F.lit(1), b % CUT)
        return F.when(i == j, F.substr(piece(i), a % CUT + 1, b - a)).otherwise(F.concat(tail, middle, head))

    kept = F.zip_with("spans", "ends", lambda s, end: F.when(s["start"] >= end, F.concat(between(end, s["start"]), F.lit(mark))).otherwise(F.lit("")))
    last = F.greatest(F.element_at("ends", -1), F.element_at("spans", -1)["end"])
    rest = between(last, F.lit(CUT) * F.size("cuts"))
    clean = F.when(F.col("spans").isNull(), text).otherwise(F.concat(F.array_join(kept, ""), rest))
    out = both.withColumn("clean", clean)
    new = {text_col: F.col("clean")}
    if chars_col:
        new[chars_col] = F.length("clean").cast(docs.schema[chars_col].dataType)
    return out.select(*[new.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])


def secrets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(rendered(F.col("base")).cast("binary"), 256).alias("base_sha256"), rendered(F.col("spans")).alias("spans"))


def _oracle() -> str:
    """The same in SQL: positions by running sums over split gaps, weak parts by a plain interval join."""
    quoted = lambda r: "'" + r.replace("'", "''") + "'"
    part = """SELECT doc_id, '{kind}' AS kind, {at} AS ord, '{role}' AS role, {weak} AS weak, s AS start, s + len(m) AS "end"
      FROM (SELECT doc_id, f[i] AS m, v[i] AS val, CAST(list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(f[1:i-1], lambda x: len(x))), 0) AS INTEGER) AS s
            FROM (SELECT doc_id, f, v, g, unnest(range(1, len(f) + 1)) AS i
                  FROM (SELECT doc_id, regexp_extract_all(text, {rx}) AS f, regexp_extract_all(text, {rx}, {group}) AS v, string_split_regex(text, {rx}) AS g FROM d WHERE regexp_matches(text, {rx})) a) b) c
      WHERE len(val) >= {least}{most}"""
    parts = "\nUNION ALL\n".join(
        part.format(kind=p.kind, at=i, role=p.role, weak=str(p.weak).lower(), rx=quoted(p.regex), group=p.group, least=p.least, most="" if p.most is None else f" AND len(val) <= {p.most}") for i, p in enumerate(PATTERNS)
    )
    near = "EXISTS (SELECT 1 FROM p q WHERE q.doc_id = p.doc_id AND q.role = '{0}' AND abs(q.start - p.start) <= " + str(SCOPE) + ")"
    ident, secret = near.format("id"), near.format("secret")
    text = """kind || ':' || start || ':' || "end" """
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS MATERIALIZED ({parts}),
kept AS (SELECT * FROM p WHERE NOT weak OR (role = 'id' AND {secret}) OR (role = 'secret' AND {ident}) OR (role = 'endpoint' AND {ident} AND {secret})),
a AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
             string_agg({text}, ',' ORDER BY start, ord) FILTER (WHERE NOT weak) AS base, string_agg({text}, ',' ORDER BY start, ord) AS spans FROM kept GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a ON d.doc_id = a.doc_id"""


ORACLE = _oracle()
