"""Best-fit packing of tokenised documents into fixed-length sequences.

How many sequences are needed depends only on how many pieces there are of each length, and there are at most
``seq_len`` lengths. So the documents stay distributed: the cluster tokenises them and counts the lengths, the driver
packs that bounded histogram by bin completion with branch and bound, and the plan it returns, a bounded list of runs
of equal sequences, places every piece by its rank among those of its length.
"""

from __future__ import annotations

import base64
import json
import math
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.common import arrow_batches, materialize

SEQ_LEN = 1024
END_ID = 2
#: Rows of one length are ranked within salted groups of about this many, so no group grows with the data.
GROUP_ROWS = 1_000_000
#: Starts of these groups are broadcast up to so many rows.
BROADCAST_GROUPS = 500_000
#: Limits of the search: nodes, and kinds of lengths up to which states are remembered; the incumbent stands where it ends.
NODES, REMEMBERED = 5_000, 48
#: Dominated fillings that count as one node.
PASSED = 50

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Runs of white space from this length on overflow the stack of the tokeniser's regular expressions.
_LONG_SPACE = re.compile(r"\s{100000,}")


def _byte_level(model: dict) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """Ranks and control strings of a tokenizers file, if it is a plain byte-level BPE whose ids follow its merges."""
    bpe, first = model["model"], model["pre_tokenizer"] or {}
    plain = bpe["type"] == "BPE" and first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space") and not model["normalizer"]
    added = model["added_tokens"]
    if not plain or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        return None
    # the printable stand-ins for bytes
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in bpe["merges"]]
    if len(bpe["vocab"]) != 256 + len(merged) or any(bpe["vocab"][w] != 256 + k for k, w in enumerate(merged)):
        return None
    return {bytes(byte_of[c] for c in w): k for w, k in bpe["vocab"].items()}, {t["content"]: t["id"] for t in added}


@cache
def encoder(vocabulary: str) -> Callable[[str], list[int]]:
    """The byte-level BPE of a ``.json`` file of the tokenizers library, or of a ``.tiktoken`` rank file.

    Control strings that a ``.json`` file lists become their ids, as in that library; a rank file has none. A plain
    byte-level file is run by the faster of the two libraries, with equal ids (tested). A process loads a vocabulary once.
    """
    import public_tokenizers
    import tiktoken

    if vocabulary.endswith(".json"):
        with open(vocabulary) as f:
            known = _byte_level(json.load(f))
        if known is None:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(vocabulary)
            return lambda text: model.encode(text, add_special_tokens=False).ids
        ranks, controls = known
    else:
        with open(vocabulary, "rb") as f:
            ranks, controls = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, {}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    split = re.compile("(" + "|".join(map(re.escape, sorted(controls, key=len, reverse=True))) + ")") if controls else None

    def plain(text: str) -> list[int]:
        if len(text) < 100_000 or not _LONG_SPACE.search(text):
            return own.encode_ordinary(text)
        out, at = [], 0
        for m in _LONG_SPACE.finditer(text):
            # the pattern takes a run as one piece, but for its last sign if text follows
            end = m.end() - (m.end() < len(text))
            out += own.encode_ordinary(text[at : m.start()]) + own._encode_single_piece(text[m.start() : end])
            at = end
        return out + own.encode_ordinary(text[at:])

    def encode(text: str) -> list[int]:
        if split is None or not any(c in text for c in controls):
            return plain(text)
        parts = split.split(text)  # a control string parts the text around it
        return [i for k, part in enumerate(parts) for i in ([controls[part]] if k % 2 else plain(part))]

    return encode


def cut(n: int, seq_len: int = SEQ_LEN) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: a shorter first one if ``seq_len`` doesn't divide ``n``, then full ones."""
    first = n % seq_len or min(n, seq_len)
    return [(0, first)] + [(s, seq_len) for s in range(first, n, seq_len)]


def pieces(docs: DataFrame, vocabulary: str, seq_len: int = SEQ_LEN, end_id: int = END_ID) -> DataFrame:
    """One row per piece of each document's ids; a null text is empty and yields the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                out += [(doc_id, k, s, n, zlib.crc32(ids[s : s + n])) for k, (s, n) in enumerate(cut(len(ids), seq_len))]
            columns = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    arrow_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, PIECES)


def lower_bound(counts: dict[int, int], room: int) -> int:
    """Martello and Toth's L2: no packing of these lengths needs fewer bins."""
    total = sum(n * c for n, c in counts.items())
    best = math.ceil(total / room)
    for k in sorted(n for n in counts if n <= room // 2):
        big = sum(c for n, c in counts.items() if n > room - k)
        half = [(n, c) for n, c in counts.items() if room - k >= n > room // 2]
        n_half, s_half = sum(c for _, c in half), sum(n * c for n, c in half)
        s_small = sum(n * c for n, c in counts.items() if room // 2 >= n >= k)
        best = max(best, big + n_half + max(0, math.ceil((s_small - (n_half * room - s_half)) / room)))
    return best


Plan = list[tuple[tuple[tuple[int, int], ...], int]]  # ((length, times in a bin)..., number of such bins)


Filling = tuple[tuple[int, int], ...]


def _change(counts: dict[int, int], filling: Filling, times: int) -> None:
    """Use ``filling`` so often; a negative number gives it back."""
    for n, k in filling:
        now = counts.get(n, 0) - k * times
        if now:
            counts[n] = now
        else:
            del counts[n]


def best_fit(counts: dict[int, int], room: int) -> Plan:
    """Best-fit decreasing over the histogram: each piece goes into the fullest bin that holds it.

    Equal bins are kept together, so the cost depends on the number of lengths only.
    """
    bins: dict[int, list[tuple[Filling, int]]] = {}  # by what is left free
    frees: list[int] = []

    def put(free: int, filling: Filling, times: int) -> None:
        if free not in bins:
            bins[free] = []
            insort(frees, free)
        bins[free].append((filling, times))

    for n in sorted(counts, reverse=True):
        c = counts[n]
        while c:
            at = bisect_left(frees, n)
            free = frees[at] if at < len(frees) else room
            if at < len(frees):
                filling, times = bins[free].pop()
                if not bins[free]:
                    del bins[free], frees[at]
            else:
                filling, times = (), c
            each = free // n  # a bin that took one is the fullest for the next
            full = min(times, c // each)
            rest = min(each, c - full * each) if full < times else 0
            if full:
                put(free - each * n, (*filling, (n, each)), full)
            if rest:
                put(free - rest * n, (*filling, (n, rest)), 1)
            if filling and (same := times - full - bool(rest)):
                put(free, filling, same)
            c -= full * each + rest
    return [x for group in bins.values() for x in group]


def largest_first(counts: dict[int, int], room: int) -> Plan:
    """One bin after the other takes the largest piece that fits, again and again."""
    counts, plan = dict(counts), []
    while counts:
        left, filling = room, {}
        for n in sorted(counts, reverse=True):
            if k := min(counts[n], left // n):
                filling[n] = k
                left -= n * k
        key = tuple(filling.items())
        times = min(counts[n] // k for n, k in key)
        _change(counts, key, times)
        plan.append((key, times))
    return plan


def fillings(counts: dict[int, int], room: int, spare: int | None = None) -> Iterator[Filling]:
    """The undominated ones of ``candidates``."""
    return (x for x in candidates(counts, room, spare) if x is not None)


def candidates(counts: dict[int, int], room: int, spare: int | None = None) -> Iterator[Filling | None]:
    """All undominated fillings of a bin around the largest length that waste ``spare`` at most, the least waste first.

    A filling is dominated, after Martello and Toth, if a piece that is left could be added, or could take the place of
    a shorter one or of two that together aren't longer: then some packing as good has the better filling. Sums that
    can be reached are bit sets, so the search for a sum has no dead ends. Each dominated filling comes as None, so that
    who asks can stop.
    """
    top = max(counts)
    free = room - top
    rest = {n: c - (n == top) for n, c in counts.items() if n <= free and c - (n == top)}
    sizes = sorted(rest, reverse=True)
    # below[i]: the sums that sizes[i:] can make, up to free, as bits
    below, mask = [1] * (len(sizes) + 1), (1 << (free + 1)) - 1
    for i in range(len(sizes) - 1, -1, -1):
        bits, k, step = below[i + 1], rest[sizes[i]], 1
        while k > 0 and step * sizes[i] <= free:
            take = min(step, k)
            bits |= (bits << (take * sizes[i])) & mask
            k, step = k - take, step * 2
        below[i] = bits
    every = 0
    for n in sizes:
        every |= 1 << n

    def sums(i: int, left: int, chosen: Filling) -> Iterator[Filling]:
        if not left:
            yield chosen
            return
        for j in range(bisect_left(sizes, -left, i, key=lambda n: -n), len(sizes)):
            if not below[j] >> left & 1:
                return
            n = sizes[j]
            for k in range(min(rest[n], left // n), 0, -1):
                if below[j + 1] >> (left - k * n) & 1:
                    yield from sums(j + 1, left - k * n, (*chosen, (n, k)))

    def dominated(chosen: Filling, waste: int) -> bool:
        others = every
        for n, k in chosen:
            if rest[n] == k:
                others ^= 1 << n
        longer, as_long = (1 << waste) - 1, (1 << (waste + 1)) - 1
        if others >> 1 & longer or any(others >> (n + 1) & longer for n, _ in chosen):
            return True
        own = [n for n, k in chosen for _ in range(min(k, 2))]
        return any(others >> (a + b) & as_long for x, a in enumerate(own) for b in own[:x])

    for target in range(free, -1 if spare is None else max(-1, free - spare - 1), -1):
        if below[0] >> target & 1:
            for chosen in sums(0, target, ()):
                if dominated(chosen, free - target):
                    yield None
                else:
                    used = dict(chosen)
                    used[top] = used.get(top, 0) + 1
                    yield tuple(sorted(used.items(), reverse=True))


def bin_completion(counts: dict[int, int], room: int = SEQ_LEN, nodes: int = NODES) -> Plan:
    """As few bins as found for ``counts`` (length -> pieces): branch and bound over undominated fillings of the largest.

    The better of two best-fit solutions is the first incumbent. A filling is used as often as it can be first, then
    less often, down to once, and not again for the same largest length, so no packing is left out. A branch ends once
    its waste, or the bound of what is left, shows that it can't beat the incumbent. The search is depth-first for a
    third of ``nodes``; if that doesn't exhaust it, it goes on with one deviation from the first choices, then two, and
    so on. It ends at the lower bound, when nothing is left to try, or after ``nodes``, keeping the incumbent. Equal
    bins are filled together, so the cost doesn't depend on the number of documents.
    """
    left = {n: c for n, c in counts.items() if c}
    if not left:
        return []
    best = min(best_fit(left, room), largest_first(left, room), key=lambda p: sum(t for _, t in p))
    state = _State(left, room, best, lower_bound(left, room))
    state.dive(nodes // 3, None)
    deviations = 1
    while not state.over and state.seen < nodes:
        before = state.seen
        state.dive(nodes, deviations)
        deviations += 1
        if state.seen == before:
            break
    return state.best


class _State:
    """A histogram that is changed and restored along the path of the search, so memory grows with the depth only."""

    def __init__(self, left: dict[int, int], room: int, best: Plan, floor: int):
        self.left, self.room, self.best, self.floor = left, room, best, floor
        self.total = sum(n * c for n, c in left.items())
        self.bins = sum(t for _, t in best)
        self.seen, self.passed, self.over = 0, 0, self.bins <= floor

    def options(self, spare: int, banned: frozenset) -> Iterator[tuple[Filling, int] | None]:
        for filling in candidates(self.left, self.room, spare):
            if filling is None or filling in banned:
                yield None
            else:
                for times in range(min(self.left[n] // k for n, k in filling), 0, -1):
                    yield filling, times

    def dive(self, nodes: int, deviations: int | None) -> None:
        """Search until ``nodes`` are seen; ``deviations``: how many choices may differ from the first ones, None for any."""
        reached: dict[frozenset, int] = {}
        path: Plan = []
        used = waste = 0
        spare = lambda: (self.bins - 1) * self.room - self.total - waste
        # a frame: its choices, how many were taken, deviations left, fillings not to use again, the largest length
        frames = [[self.options(spare(), frozenset()), 0, deviations, frozenset(), max(self.left)]]
        while frames and self.seen < nodes and not self.over:
            frame = frames[-1]
            at_end = frame[1] and frame[2] == 0
            choice = () if at_end else next(frame[0], ())
            if choice is None:  # a filling that is passed over: so many of them count as a node
                self.passed += 1
                self.seen += self.passed % PASSED == 0
                continue
            if not choice:
                frames.pop()
                if path:
                    filling, times = path.pop()
                    _change(self.left, filling, -times)
                    used, waste = used - times, waste - times * (self.room - sum(n * k for n, k in filling))
                continue
            self.seen += 1
            filling, times = choice
            more = frame[2] if frame[2] is None else frame[2] - (frame[1] > 0)
            frame[1] += 1
            _change(self.left, filling, times)
            path.append(choice)
            used, waste = used + times, waste + times * (self.room - sum(n * k for n, k in filling))
            go_on = bool(self.left) and spare() >= 0
            if not self.left and used < self.bins:
                self.best, self.bins = list(path), used
                self.over = used <= self.floor
            if go_on and len(self.left) <= REMEMBERED:
                key = frozenset(self.left.items())
                go_on = (deviations is not None or reached.get(key, used + 1) > used) and used + lower_bound(self.left, self.room) < self.bins
                if deviations is None:
                    reached[key] = min(used, reached.get(key, used))
            top = max(self.left) if go_on else 0
            banned = frame[3] | {filling} if top == frame[4] else frozenset()
            frames.append([self.options(spare(), banned) if go_on else iter(()), 0, more, banned, top])
        if not frames and deviations is None:
            self.over = True  # nothing is left to try
        for filling, times in reversed(path):
            _change(self.left, filling, -times)


def runs(plan: Plan) -> list[tuple[int, int, int, int]]:
    """(length, first rank, first sequence, offset) of each slot of the plan, sorted: ranks count pieces of one length."""
    at: dict[int, int] = {}
    out, sequence = [], 0
    for filling, times in plan:
        offset = 0
        for n, k in filling:
            for _ in range(k):
                out.append((n, at.get(n, 0), sequence, offset))
                at[n] = at.get(n, 0) + times
                offset += n
        sequence += times
    return sorted(out)


def pack(docs: DataFrame, vocabulary: str, seq_len: int = SEQ_LEN, end_id: int = END_ID) -> DataFrame:
    """``docs(doc_id, text)`` to one row per piece with ``sequence_id`` and ``offset``.

    Null texts are empty, repeated rows are packed as often as they come, null ids are carried along, an empty table
    gives no rows, and other columns are ignored. Every piece lies in exactly one sequence, gapless from 0.
    """
    cuts = materialize(pieces(docs, vocabulary, seq_len, end_id), "pieces")
    counts = dict(cuts.groupBy("length").count().collect())  # at most seq_len rows
    plan = np.array(runs(bin_completion(counts, seq_len)), dtype=np.int64).reshape(-1, 4)
    salts = max(8, math.ceil(max(counts.values(), default=0) / GROUP_ROWS))
    salted = cuts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    # ranks: within the salted group by sorting, then past the groups before it
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "_salt").count().select("length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    starts = F.broadcast(starts) if seq_len * salts <= BROADCAST_GROUPS else starts
    ranked = salted.withColumn("_rank", F.row_number().over(within) - 1).join(starts, ["length", "_salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("_before")).alias("_rank"))
    # the plan has a bounded number of runs, whatever the number of documents, and travels with the function
    key_room = 1 << 44
    keys = plan[:, 0] * key_room + plan[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            k = np.searchsorted(keys, length * key_room + rank, side="right") - 1
            columns = [batch.column(i) for i in range(5)]
            columns += [pa.array(plan[k, 2] + rank - plan[k, 1]), pa.array(plan[k, 3])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")
