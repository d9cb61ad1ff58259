"""Secret scans, in DataFrame functions only: known patterns, and entropy over sliding windows.

The entropy part looks at candidate strings (long runs of one alphabet). A candidate is split
into character codes once. The counts of the window's characters are kept along the way and
change by one in and one out at each step, and so does the sum of c * log2(c) over the window;
the entropy is log2(width) - sum / width. A candidate whose best window reaches the threshold of
its character class is reported, unless the allow-list names it. All of it takes time in
proportion to the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns, the group whose length counts, and its least length.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),  # the runs of [0-9a-f]+ that have 32 characters or more
}
#: Character classes of candidates: pattern, window width, least entropy in bits a character.
CLASSES = {
    "entropy_hex": (r"(?<![A-Za-z0-9+/_=-])[0-9a-fA-F]{24,}(?![A-Za-z0-9+/_=-])", 24, 3.2),
    "entropy_base64": (r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[A-Za-z0-9+/_=-]*[A-Z])(?=[A-Za-z0-9+/_=-]*[a-z])[A-Za-z0-9+/_=-]{24,}", 24, 3.9),
}
#: Strings that are never reported for their entropy: placeholders, and runs of one character.
ALLOW = [r"(?i)(?<![a-z0-9])(example|sample|dummy|placeholder|changeme)(?![a-z])", r"(?i)^(example|sample|dummy|placeholder|changeme)", r"^(.)\1+$", r"(?i)^(0123456789abcdef|abcdefghijklmnopqrstuvwxyz)+$"]
#: Codes of the characters of candidates run from that of + to that of z.
LOW_CODE, CODES = 43, 80
#: Matches whose places are summed up together.
MATCHES = 256


def _clog(n: Column) -> Column:
    return F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def best_entropy(text: Column, width: int) -> Column:
    """The largest Shannon entropy of a window of width characters; texts shorter than that: of the whole text as a window of its own length.

    Characters are those of candidates, from + to z by code point.
    """
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c) - LOW_CODE)
    n = F.least(F.lit(width), F.length(text))

    def first(acc: Column, come: Column) -> Column:
        had = F.get(acc["counts"], come)
        counts = F.transform(acc["counts"], lambda v, k: v + F.when(k == come, 1).otherwise(0))
        return F.struct(counts.alias("counts"), (acc["now"] + _clog(had + 1) - _clog(had)).alias("now"), acc["least"].alias("least"))

    def slid(made: Column) -> Column:
        """The state is a window's counts alone: Spark copies it at each step."""
        whole, size = made["codes"], made["n"]

        def step(acc: Column, i: Column) -> Column:
            gone, come = F.get(whole, i - size), F.get(whole, i)
            a, b = F.get(acc["counts"], gone), F.get(acc["counts"], come)
            now = acc["now"] + F.when(gone == come, F.lit(0.0)).otherwise(_clog(a - 1) - _clog(a) + _clog(b + 1) - _clog(b))
            counts = F.transform(acc["counts"], lambda v, k: v + F.when(k == come, 1).otherwise(0) - F.when(k == gone, 1).otherwise(0))
            return F.struct(counts.alias("counts"), now.alias("now"), F.least(acc["least"], now).alias("least"))

        zero = F.struct(F.array_repeat(F.lit(0), CODES).alias("counts"), F.lit(0.0).alias("now"), F.lit(float("inf")).alias("least"))
        begun = F.aggregate(F.slice(whole, F.lit(1), size), zero, first, lambda acc: F.struct(acc["counts"].alias("counts"), acc["now"].alias("now"), acc["now"].alias("least")))
        steps = F.when(F.size(whole) > size, F.sequence(size, F.size(whole) - 1)).otherwise(F.array().cast("array<int>"))
        return F.log2(size.cast("double")) - F.aggregate(steps, begun, step, lambda acc: acc["least"]) / size

    return F.get(F.transform(F.array(F.struct(codes.alias("codes"), n.alias("n"))), slid), F.lit(0))


def _positions(text: Column, pattern: str, found: Column) -> Column:
    """array<struct<start, end>> of the matches of a pattern, from their lengths and those of the gaps between them.

    Sums run over stretches of MATCHES matches, whose own lengths are summed first, so no array
    grows by one at a time but within a stretch.
    """
    # gap and match, in turn
    lengths = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
    total = lambda some: F.aggregate(some, F.lit(0), lambda at, x: at + x["g"] + x["m"])
    kind = "array<struct<start:int,end:int>>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["g"]
        return F.struct((start + x["m"]).alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), (start + x["m"]).alias("end")))).alias("out"))

    def places(all_: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / MATCHES).cast("int")), lambda k: F.slice(all_, k * MATCHES + 1, MATCHES))
        sized = F.transform(F.array(F.transform(blocks, total)), lambda sums: F.transform(blocks, lambda b, k: F.struct(b.alias("b"), F.aggregate(F.slice(sums, F.lit(1), k), F.lit(0), lambda at, x: at + x).alias("at"))))
        return F.flatten(F.transform(F.get(sized, F.lit(0)), lambda b: F.aggregate(b["b"], F.struct(b["at"].alias("at"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"])))

    return F.get(F.transform(F.array(lengths), places), F.lit(0))


_SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _long_enough(pattern: str, group: int, least: int):
    return lambda m: F.length(F.regexp_extract(m, pattern, group)) >= least


def _random_enough(width: int, bits: float, allow: list[str]):
    def check(m: Column) -> Column:
        named = F.lit(False)
        for p in allow:
            named = named | m.rlike(p)
        return F.when(named, False).otherwise(best_entropy(m, width) >= bits)

    return check


def _span(rank: int, kind: str):
    return lambda w, keep: F.when(keep, F.struct(w["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), w["end"].alias("end")))


def _is_kind(kind: str):
    return lambda s: s["kind"] == kind


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: list[str] | None = None) -> DataFrame:
    """The spans of each whole text: (id, base, spans), arrays of (start, rank, kind, end) by start, then kind as listed.

    Positions are code points, the end exclusive. Matches of a kind are leftmost and do not
    overlap; base holds the kinds of BASE, spans those and the entropy kinds of CLASSES. Null and
    empty texts have empty arrays; null ids stay; repeated rows give repeated rows; an empty
    table gives no rows; other columns are not read.
    """
    allow = ALLOW if allow is None else allow
    kinds = {**{k: p[0] for k, p in BASE.items()}, **{k: p[0] for k, p in CLASSES.items()}}
    out = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    out = out.select("_id", "_t", *[F.regexp_extract_all("_t", F.lit(p), 0).alias(f"_m_{k}") for k, p in kinds.items()])
    empty = F.array().cast(_SPAN)
    spans = []
    for rank, (kind, pattern) in enumerate(kinds.items()):
        found = F.col(f"_m_{kind}")
        where = _positions(F.col("_t"), pattern, found)
        if kind in BASE:
            _, group, least = BASE[kind]
            keep = F.transform(found, _long_enough(pattern, group, least))
        else:
            _, width, bits = CLASSES[kind]
            keep = F.transform(found, _random_enough(width, bits, allow))
        made = F.zip_with(where, keep, _span(rank, kind))
        made = F.filter(made, lambda s: s.isNotNull())
        spans.append(F.when(F.size(found) > 0, made).otherwise(empty).alias(f"_s_{kind}"))
    out = out.select("_id", *spans)
    base = F.concat(*[F.col(f"_s_{k}") for k in BASE])
    return out.select(F.col("_id").alias(id_col), F.array_sort(base).alias("base"), F.array_sort(F.concat(base, *[F.col(f"_s_{k}") for k in CLASSES])).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) from the spans of find_secrets."""
    counts = [F.size(F.filter("base", _is_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(id_col, *counts, F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))
