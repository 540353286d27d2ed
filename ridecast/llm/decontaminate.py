"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton is built once from the items' words and broadcast; its size is twice the words of the items at most. Items
of more than ``block_bytes`` together are taken in blocks, each with an automaton and a pass of its own.  Documents are
streamed: words become vocabulary numbers in numpy, only runs whose word pairs all occur in an item are walked,
and the walk tracks the longest match that ends at each word.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridecast.llm.common import alnum_words, fields, find_words, hash_words, lower_table, text_slices
from ridecast.session import cut_lineage

BLOCK_BYTES = 1 << 23


@dataclass
class Automaton:
    """States 1.. of the suffix automaton; 0 is the root.  ``step`` maps (state, word) to a state."""
    vocab: np.ndarray                                   # sorted word hashes
    pairs: np.ndarray                                   # sorted codes of neighbouring words
    shortest: int                                       # words of the shortest window
    window: int
    step: list[dict[int, int]] = field(default_factory=list)
    link: list[int] = field(default_factory=list)
    length: list[int] = field(default_factory=list)
    items: dict[int, tuple] = field(default_factory=dict)     # state of a full window: items that hold it
    whole: dict[int, list] = field(default_factory=dict)      # state: (words, item) of short items that it spells


def _words(texts: list[str | None]) -> list[np.ndarray]:
    """Word hashes of each normalised text."""
    lower, table, out = lower_table(), alnum_words(), []
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    for _, _, raw, offs in text_slices(batch):
        raw = lower[raw]
        starts, ends, first = find_words(raw, offs, table)
        out += np.split(hash_words(raw, starts, ends), first[1:-1])
    return out


def build(items: list[tuple], window: int = 10) -> Automaton:
    """The automaton of (item_id, text) pairs; items without words add nothing."""
    known = [(i, w) for (i, _), w in zip(items, _words([t for _, t in items])) if len(w)]
    vocab = np.unique(np.concatenate([w for _, w in known])) if known else np.empty(0, np.uint64)
    coded = [(i, np.searchsorted(vocab, w)) for i, w in known]
    pairs = [w[:-1] * len(vocab) + w[1:] for _, w in coded if len(w) > 1]
    a = Automaton(vocab, np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64),
                  min([window, *(len(w) for _, w in coded)]), window, [{}], [-1], [0])
    step, link, length = a.step, a.link, a.length

    def state(n, edges, up):
        length.append(n)
        step.append(edges)
        link.append(up)
        return len(length) - 1

    def split(p, c, q):
        clone = state(length[p] + 1, dict(step[q]), link[q])
        while p >= 0 and step[p].get(c) == q:
            step[p][c] = clone
            p = link[p]
        link[q] = clone
        return clone

    def extend(last, c):
        q = step[last].get(c)
        if q is not None:                                # an earlier item has this prefix
            return q if length[q] == length[last] + 1 else split(last, c, q)
        new, p = state(length[last] + 1, {}, 0), last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            link[new] = q if length[q] == length[p] + 1 else split(p, c, q)
        return new

    for _, w in coded:
        last = 0
        for c in w.tolist():
            last = extend(last, c)
    held: dict[int, set] = {}
    for i, w in coded:                                   # the states that the items' windows end in
        s = n = 0
        for c in w.tolist():
            s, n = step[s][c], n + 1                     # an item is always spelt by the automaton
            if n >= window:
                held.setdefault(_at(a, s, window), set()).add(i)
        if len(w) < window:
            a.whole.setdefault(s, []).append((len(w), i))
    a.items = {s: tuple(sorted(x, key=str)) for s, x in held.items()}
    return a


def _at(a: Automaton, s: int, n: int) -> int:
    """The state of the last n words of a match that ends in s."""
    while a.length[a.link[s]] >= n:
        s = a.link[s]
    return s


def _walk(a: Automaton, codes: list[int], hit: np.ndarray, found: set) -> None:
    """Stream one run of words; mark the words of windows in ``hit`` and collect their items."""
    step, link, length = a.step, a.link, a.length
    s = n = 0
    for at, c in enumerate(codes):
        while s and c not in step[s]:
            s = link[s]
            n = length[s]
        if c in step[s]:
            s, n = step[s][c], n + 1
        if n >= a.window:
            t = _at(a, s, a.window)
            if t in a.items:
                hit[at + 1 - a.window:at + 1] = True
                found.update(a.items[t])
        if a.whole:
            t = s
            while t > 0:
                for m, i in a.whole.get(t, ()):
                    if m <= n:
                        hit[at + 1 - m:at + 1] = True
                        found.add(i)
                t = link[t]


def _scan(docs: DataFrame, automaton: Automaton, id_type: str, doc_type: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def match(batches):
        a, lower, table = shared.value, lower_table(), alnum_words()
        for batch in batches:
            n_words, spans, items = [], [], []
            for _, _, raw, offs in text_slices(batch):
                raw = lower[raw]
                starts, ends, first = find_words(raw, offs, table)
                n_words.append(np.diff(first))
                for got in _texts(a, hash_words(raw, starts, ends), starts, ends, first, offs):
                    spans.append(got[0])
                    items.append(got[1])
            if n_words:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.concatenate(n_words), pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([(x, pa.int64()) for x in SPAN]))),
                     pa.array(items, pa.list_(pa.int64() if id_type == "bigint" else pa.string()))],
                    names=["doc_id", "n_words", "spans", "items"])

    return fields(docs, "doc_id", "text").mapInArrow(
        match, f"doc_id {doc_type}, n_words long, spans array<struct<{', '.join(f'{x}: long' for x in SPAN)}>>, "
               f"items array<{id_type}>")


#: A matched span: its first and end word, and its first and end byte in the text's UTF-8 form.
SPAN = ("first", "end", "from_byte", "to_byte")


def _texts(a, h, starts, ends, first, offs):
    """(spans, items) of each text."""
    n = len(h)
    code = np.searchsorted(a.vocab, h)
    known = np.zeros(n, bool)
    inside = code < len(a.vocab)
    known[inside] = a.vocab[code[inside]] == h[inside]
    linked = np.zeros(n, bool)                           # a word and the next one stand together in an item
    if n > 1 and len(a.pairs):
        both = np.flatnonzero(known[:-1] & known[1:])
        pair = code[both] * len(a.vocab) + code[both + 1]
        at = np.minimum(np.searchsorted(a.pairs, pair), len(a.pairs) - 1)
        linked[both] = a.pairs[at] == pair
    tails = first[1:] - 1
    linked[tails[tails >= 0]] = False
    begins = np.flatnonzero(known & ~np.concatenate(([False], linked[:-1])))
    stops = np.flatnonzero(known & ~linked) + 1
    long = stops - begins >= a.shortest
    begins, stops = begins[long], stops[long]
    lo, hi = np.searchsorted(begins, first[:-1]), np.searchsorted(begins, first[1:])
    for d in range(len(first) - 1):
        spans, found = [], set()
        for x, y in zip(begins[lo[d]:hi[d]].tolist(), stops[lo[d]:hi[d]].tolist()):
            hit = np.zeros(y - x, bool)
            _walk(a, code[x:y].tolist(), hit, found)
            edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))).tolist()
            for p, q in zip(edge[::2], edge[1::2]):
                p, q = p + x, q + x
                if spans and spans[-1]["end"] == p - first[d]:           # two runs that touch
                    spans[-1] |= {"end": q - int(first[d]), "to_byte": int(ends[q - 1] - offs[d])}
                else:
                    spans.append(dict(zip(SPAN, (p - int(first[d]), q - int(first[d]), int(starts[p] - offs[d]),
                                                 int(ends[q - 1] - offs[d])))))
        yield spans, sorted(found, key=str)


def find_leaks(docs: DataFrame, items: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, spans (of consecutive words inside item windows), items.

    Words: after lower-casing A-Z, runs of digits, a-z and characters beyond ASCII.  A window is ``window`` consecutive
    item words, or a whole shorter item.  Null and empty texts have no words; without items nothing is hit.
    Items: ids of the items with a window in the document, each once, sorted as strings; an item id may repeat.
    Rows are on their own: repeated and null doc_ids stay apart.  Items of over ``block_bytes`` are scanned for in blocks, a
    pass over the documents each, whose finds are joined by row."""
    items = fields(items, "item_id", "text").where("item_id is not null and text is not null")
    id_type, doc_type = dict(items.dtypes)["item_id"], dict(docs.dtypes)["doc_id"]
    if id_type not in ("bigint", "string"):
        items, id_type = items.withColumn("item_id", F.col("item_id").cast("long")), "bigint"
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(-(-total // block_bytes)) or 1
    if blocks > 1:                                       # rows get a number that stays the same in every pass
        docs = cut_lineage(docs.select(F.struct(F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("id"))
                                       .alias("doc_id"), "text"))
        doc_type = dict(docs.dtypes)["doc_id"]
    parts = []
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        parts.append(_scan(docs, build([(r["item_id"], r["text"]) for r in own], window), id_type, doc_type))
    if blocks == 1:
        return parts[0]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    flat = (out.groupBy("doc_id.row").agg(F.first("doc_id.id").alias("doc_id"), F.max("n_words").alias("n_words"),
                                      F.flatten(F.collect_list("spans")).alias("spans"),
                                      F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")))
    joined = F.aggregate(
        F.array_sort("spans"), F.expr("cast(array() as array<struct<first: bigint, end: bigint, from_byte: bigint, to_byte: bigint>>)"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["first"]), F.concat(
            F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(
                F.element_at(acc, -1)["first"].alias("first"),
                F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"),
                F.element_at(acc, -1)["from_byte"].alias("from_byte"),
                F.greatest(F.element_at(acc, -1)["to_byte"], s["to_byte"]).alias("to_byte"))))
        ).otherwise(F.concat(acc, F.array(s))))
    return flat.select("doc_id", "n_words", joined.alias("spans"),
                       F.array_sort("items", lambda x, y: F.when(x.cast("string") < y.cast("string"), -1)
                                    .when(x.cast("string") > y.cast("string"), 1).otherwise(0)).alias("items"))


def n_hit(spans):
    """Words inside the spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])


def remove_leaks(docs: DataFrame, items: DataFrame, window: int = 10, min_span: int = 1,
                 max_coverage: float = 0.5) -> DataFrame:
    """``docs`` with every span of at least ``min_span`` words cut out of ``text``, and without the rows of which
    more than ``max_coverage`` of the words are hit.  Other rows and columns stay as they are; each row is on its own, a
    null text has no words, an empty table gives an empty one."""
    # a row travels whole in the place of its id, so that no join is needed and no column can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_id"), F.col("text").alias("text"))
    leaks = find_leaks(rows, items, window).withColumn("hit", n_hit(F.col("spans"))).where(
        "hit = 0 or hit <= %r * n_words" % float(max_coverage))
    leaks = leaks.select(F.col("doc_id").alias("row"), F.when(F.col("hit") > 0, F.filter(
        "spans", lambda s: s["end"] - s["first"] >= min_span)).alias("spans"))
    raw = F.encode(F.col("row.text"), "UTF-8")
    bounds = F.transform("spans", lambda s, i: F.struct(
        F.when(i == 0, F.lit(0).cast("long")).otherwise(F.element_at("spans", F.greatest(i, F.lit(1)))["to_byte"])
        .alias("a"), s["from_byte"].alias("b")))
    kept = F.concat(F.array_join(F.transform(bounds, lambda x: F.decode(
        F.substring(raw, (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int")), "UTF-8")), ""),
        F.decode(F.substring(raw, (F.element_at("spans", -1)["to_byte"] + 1).cast("int"), F.octet_length("row.text")),
                 "UTF-8"))
    text = F.when(F.size("spans") > 0, kept).otherwise(F.col("row.text"))
    return leaks.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
