"""A dataset manifest: a Merkle tree over rows, and for every row the proof that it belongs.

Each row is a leaf, hashed from its fields. The leaves of a group stand in order, every eight consecutive nodes
become the hash of their digests until one is left (the group's subroot), and the subroots become the root in the
same way. A proof is a list of coordinates first: a leaf's place and the number of leaves of its group determine
the place of every sibling up to the root. Leaves explode those coordinates, join the written table of nodes, order
what they find and fold it with their own digest.

Coordinates are looked up a level at a time from the top: the nodes of a level look up their siblings there and
inherit what the node above them has found. So a coordinate is asked for by at most eight rows at whatever height, no
node is a hot key, and what all leaves of a subtree share is looked up once. Tables and shuffles hold digests as 32
bytes; they become text where they are hashed. Every table of nodes grows with the data, so none is broadcast.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize
from .ranks import placed

FAN = 8
_BITS = 3  # of a place within a run of FAN nodes
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<before:binary,after:binary>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def text_of(digests: Column) -> Column:
    """Digests as lowercase hex."""
    return F.lower(F.hex(digests))


def field(value: Column) -> Column:
    """`-` for null, else the count of UTF-8 bytes, `:` and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


class Tree(NamedTuple):
    """nodes[k]: __g, __n (leaves of the group), __at, __digest of level k; a group has no level above its subroot."""

    nodes: list[DataFrame]

    def tops(self) -> DataFrame:
        """__g, __n and __digest of each group's subroot."""
        out = None
        for k, level in enumerate(self.nodes):
            single = level.where(_ends_at(k))
            out = single if out is None else out.unionByName(single)
        return out.select("__g", "__n", "__digest")


def _ends_at(level: int) -> Column:
    """Whether a group's subroot is on this level."""
    return (F.col("__n") <= FAN**level) & (F.col("__n") > (FAN ** (level - 1) if level else 0))


def build(leaves: DataFrame, tag: str) -> Tree:
    """All levels over leaves __g, __n, __at, __digest; each is a written table, an eighth of the one below."""
    largest = leaves.agg(F.max("__n").alias("n")).first()["n"] or 0
    nodes, size = [leaves.select("__g", "__n", "__at", "__digest")], 1
    while size < largest:
        members = nodes[-1].where(F.col("__n") > size).select("__g", "__n", F.shiftright("__at", _BITS).alias("__at"), F.struct("__at", "__digest").alias("__node"))
        runs = members.groupBy("__g", "__n", "__at").agg(F.array_sort(F.collect_list("__node")).alias("__run"))  # at most FAN each
        inner = F.array_join(F.transform("__run", lambda node: text_of(node["__digest"])), "")
        nodes.append(materialize(runs.select("__g", "__n", "__at", F.unhex(digest(inner)).alias("__digest")), f"{tag}-level{len(nodes)}"))
        size *= FAN
    return Tree(nodes)


def _siblings(level: int) -> Column:
    """Places of the siblings of a node that is not its group's subroot; the last run may be short, even a single node."""
    start = F.shiftleft(F.shiftright("__at", _BITS), _BITS)
    last = F.least(start + FAN, F.shiftright(F.col("__n") + (FAN**level - 1), _BITS * level)) - 1
    return F.filter(F.sequence(start, last), lambda place: place != F.col("__at"))


def _side(test) -> Column:
    """The digests of the siblings whose place passes, in order, as one binary value."""
    found = F.filter("__found", lambda s: s["place"].isNotNull() & test(s["place"]))
    return F.aggregate(found, F.lit(b""), lambda acc, s: F.concat(acc, s["digest"]))


def paths(tree: Tree, tops: DataFrame, carry: list[str], tag: str, payload: DataFrame) -> DataFrame:
    """__g, __n, __at, __steps of every leaf, from the leaf to the root, with `carry` and the columns of `payload`.

    tops: __g, __n, __steps above the group's subroot, and `carry`. payload: __g, __n, __at and more, a row a leaf."""
    above = None
    for level in range(len(tree.nodes) - 1, -1, -1):
        single = tops.where(_ends_at(level)).select("__g", "__n", F.lit(0).cast("long").alias("__at"), "__steps", *carry)
        if level == 0:  # groups of one leaf
            single = single.join(payload, ["__g", "__n", "__at"])
        if above is None:
            above = single
            continue
        members = tree.nodes[level].where(F.col("__n") > FAN**level).select("__g", "__n", "__at")
        asked = members.select("*", F.explode_outer(_siblings(level)).alias("place"))  # a run of one asks for none
        table = tree.nodes[level].select("__g", F.col("__at").alias("place"), F.col("__digest").alias("digest"))
        found = asked.join(table.hint("merge"), ["__g", "place"], "left").groupBy("__g", "__n", "__at")
        found = found.agg(F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("__found"))
        at = F.col("__at")
        own = found.select("__g", "__n", "__at", F.struct(_side(lambda p: p < at).alias("before"), _side(lambda p: p > at).alias("after")).alias("__own"))  # noqa: B023
        if level == 0:
            own = own.join(payload.hint("merge"), ["__g", "__n", "__at"])  # before the long steps from above come in
        upper = above.select("__g", F.col("__at").alias("__up"), "__steps", *carry)
        own = own.withColumn("__up", F.shiftright("__at", _BITS)).join(upper.hint("merge"), ["__g", "__up"])
        above = own.withColumn("__steps", F.concat(F.array("__own"), "__steps")).drop("__own", "__up").unionByName(single)
        if level:
            above = materialize(above, f"{tag}-paths{level}")
    return above


def proofs(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, changed: dict[str, Column] | None = None) -> DataFrame:
    """The manifest of all rows and the check of every row against it.

    Returns id_col, leaf, subroot, root, steps (array of the digests before and after the folded one, leaf to root),
    proof_sha256, folded_root and verified. Leaves hash `fields` in order; those of a group ascend by id_col; the
    groups' subroots, in bytewise order of group_col, null first, build the root in the same way. `changed` gives
    fields as a holder presents them at the check (by default as they are); the tree itself is of the unchanged rows.

    Null fields count as `-`. Null ids come first; rows of one id stand by their leaves; whole rows that repeat are leaves
    of their own, and which of them comes first makes no difference. An empty table gives no rows. Other columns are
    not read. Texts are read once and hashed where they are read; all that is shuffled are digests.
    """
    changed = changed or {}
    plain = [field(F.col(c)) for c in fields]
    shown = [field(changed.get(c, F.col(c))) for c in fields]
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    leaf = docs.select(F.col(id_col).alias("__id"), group.alias("__g"), F.unhex(digest(*plain)).alias("__digest"), F.unhex(digest(*shown) if changed else F.lit(None).cast("string")).alias("__shown"))
    hashed = materialize(leaf, "manifest-leaves")
    leaves = placed(hashed, "__g", ["__id", "__digest"], "manifest")
    forget(hashed)
    tree = build(leaves, "manifest")
    subroots = materialize(tree.tops().select(F.lit("").alias("__g"), F.col("__g").alias("__group"), F.col("__n").alias("__leaves"), "__digest"), "manifest-subroots")
    ranked = placed(subroots, "__g", ["__group"], "manifest-groups")
    crown = build(ranked, "manifest-crown")
    root = crown.tops().select(F.lit("").alias("__g"), "__n", F.array().cast(_STEPS).alias("__steps"), F.col("__digest").alias("__root"))
    named = ranked.select("__g", "__n", "__at", "__group", "__leaves", F.col("__digest").alias("__subroot"))
    tops = paths(crown, root, ["__root"], "manifest-crown", named)
    tops = materialize(tops.select(F.col("__group").alias("__g"), F.col("__leaves").alias("__n"), "__steps", "__subroot", "__root"), "manifest-tops")
    rows = paths(tree, tops, ["__subroot", "__root"], "manifest", leaves.select("__g", "__n", "__at", "__id", F.col("__digest").alias("__leaf"), "__shown"))
    texts = F.transform("__steps", lambda s: F.struct(text_of(s["before"]).alias("before"), text_of(s["after"]).alias("after")))
    rows = rows.withColumn("steps", texts).withColumn("root", text_of(F.col("__root")))
    folded = F.aggregate("steps", text_of(F.coalesce("__shown", "__leaf")), lambda acc, s: digest(s["before"], acc, s["after"]))
    siblings = F.array_join(F.transform("steps", lambda s: F.concat(s["before"], s["after"])), "")
    out = rows.select(
        F.col("__id").alias(id_col),
        text_of(F.col("__leaf")).alias("leaf"),
        text_of(F.col("__subroot")).alias("subroot"),
        "root",
        "steps",
        digest(siblings).alias("proof_sha256"),
        folded.alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
