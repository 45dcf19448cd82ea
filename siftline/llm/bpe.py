"""Byte-pair encoding as a bounded-lookahead streaming transducer, and decoding.

A pre-token is read symbol by symbol.  For every prefix the transducer knows the
last token of that prefix's encoding: it is the one vocabulary token that ends
there and stands validly after the encoding of what precedes it.  Two neighbours
are valid when no merge crosses their border before both are complete; that
follows from the merge list alone.  Which tokens end at a symbol is read off an
automaton over the vocabulary, whose state is the longest end of what was read that
begins a token.  The encodings of all prefixes form a tree, and the last token of
any later prefix starts at most ``lookahead`` symbols back, where ``lookahead`` is
the longest token of the merge list.  Once the last ``lookahead`` prefixes descend
from one node, everything up to that node is stable: it is emitted and forgotten.
The state is the window of that size.

Text is cut at ASCII white space, over which no merge, match or composition
reaches.  Each distinct pre-token of a block of text runs through the transducer
once; all of them advance side by side, a symbol at a time.  Nothing is remembered
beyond a block but a table of fixed size of which tokens may be neighbours.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A

END = "</w>"
#: Text that is worked on at once, and places (pre-tokens times window) that the transducer holds at once.
BLOCK_BYTES = 1 << 20
PLACES = 1 << 18
#: Slots, as a power of two, of the table of neighbours.
SLOTS = 19

# Where the vocabulary file's library differs from Python 3.13's Unicode tables.
NEWER_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEWER_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
#: (first upper-case letter, last, lower case of the first).
NEWER_LOWER = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3),
    (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)
#: Unicode's White_Space property.
WHITE_SPACE = ((0x9, 0xD), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
ENDINGS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def patterns() -> tuple[re.Pattern, re.Pattern]:
    """The vocabulary's pre-tokens: runs of letters, endings, single numbers and runs of others.

    Two more alternatives pass on the marks of this module: ``\\n`` ends a run, tabs
    and ``\\v`` stand for a special token.  The second pattern is for text without
    characters beyond U+FFFF, for which its sets are bitmaps.
    """
    category = [unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)]
    for kind, newer in (("L", NEWER_LETTERS), ("N", NEWER_NUMBERS)):
        for lo, hi in newer:
            category[lo : hi + 1] = kind * (hi + 1 - lo)
    space = "".join(f"\\U{lo:08x}-\\U{hi:08x}" for lo, hi in WHITE_SPACE)
    out = []
    for size in (sys.maxunicode + 1, 1 << 16):
        text = "".join(category[:size])
        letter, number = ("".join(f"\\U{m.start():08x}-\\U{m.end() - 1:08x}" for m in re.finditer(f"{k}+", text)) for k in "LN")
        out.append(re.compile("|".join([f"[{letter}]+", "\\n", *ENDINGS, f"[{number}]", f"[^{space}{letter}{number}]+", "\\t+\\v"])))
    return out[0], out[1]


def last_character(text: str) -> int:
    """The greatest code point in a text."""
    return int(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").max(initial=0))


class Lowering:
    """Composed, lower-case text; letters go one by one, so a final sigma is no special case."""

    def __init__(self):
        self._newer = {c: c - lo + low for lo, hi, low in NEWER_LOWER for c in range(lo, hi + 1)}
        self._least = min(self._newer)

    def __call__(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return (text.translate(self._newer) if last_character(text) >= self._least else text).lower()


def byte_symbols() -> list[str]:
    """The printable symbol of every byte: itself if printable in Latin-1, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Merges:
    """A merge list with its vocabulary, as arrays by token id and by merge."""

    def __init__(self, spec: dict):
        model, back = spec["model"], {s: b for b, s in enumerate(byte_symbols())}
        ids: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.names: dict[int, str] = {i: t for t, i in (ids | self.specials).items()}
        self.size = max(self.names) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        whole = np.array([ids[a + b] for a, b in pairs], np.int64)
        #: The merge that makes a token, -1 for a single symbol, and the two tokens it joins.
        self.born, self.left, self.right = (np.full(self.size, -1) for _ in range(3))
        self.born[whole] = np.arange(len(pairs))
        self.left[whole], self.right[whole] = [ids[a] for a, _ in pairs], [ids[b] for _, b in pairs]
        keys = np.array([ids[a] << 20 | ids[b] for a, b in pairs], np.int64)
        self._ranks = np.argsort(keys, kind="stable")
        self._keys = np.r_[keys[self._ranks], -1]
        made = np.flatnonzero(self.born >= 0)
        own = np.zeros(self.size, bool)
        own[made] = self.crossing(self.left[made], self.right[made]) == self.born[made]
        reachable = self.born < 0
        for token in made[np.argsort(self.born[made])].tolist():  # what is never made by its own merge is in no encoding
            reachable[token] = own[token] and reachable[self.left[token]] and reachable[self.right[token]]
        encoded = {t: bytes(back[c] for c in t.removesuffix(END)) for t in ids}
        self.inner = {encoded[t]: i for t, i in ids.items() if reachable[i] and not t.endswith(END)}
        self.final = {encoded[t]: i for t, i in ids.items() if reachable[i] and t.endswith(END)}
        self.length = np.zeros(self.size, np.int64)
        self.length[list(ids.values())] = [len(encoded[t]) for t in ids]
        #: Symbols that must follow before a token may be stable.
        self.lookahead = max(map(len, [*self.inner, *self.final]))
        self._known, self._flags = np.full(1 << SLOTS, -1), np.zeros(1 << SLOTS, bool)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge of each pair of tokens, -1 for none."""
        key = a << 20 | b
        at = np.searchsorted(self._keys[:-1], key)
        hit = self._keys[at] == key
        return np.where(hit, self._ranks[np.minimum(at, len(self._ranks) - 1)], -1) if len(self._ranks) else np.full(len(key), -1)

    def crossing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The first merge that crosses the border between the symbols of each pair of tokens, -1 for none.

        From the whole tokens back in time: the pieces x and y at the border stand
        there from the merge that makes them until the one that takes them in.
        """
        best, at = np.full(len(a), -1), np.arange(len(a))
        x, y = a, b
        x_to = y_to = np.full(len(a), 1 << 40)
        while len(at):
            x_from, y_from, r = self.born[x], self.born[y], self.rank(x, y)
            # Of equal merges the leftmost goes first: before one at y's right, after one at x's left.
            hit = (r > x_from) & (r > y_from) & (r < x_to) & (r <= y_to)
            best[at[hit]] = r[hit]
            back = y_from >= x_from
            x, x_to = np.where(back, x, self.right[x]), np.where(back, x_to, x_from)
            y, y_to = np.where(back, self.left[y], y), np.where(back, y_from, y_to)
            more = np.maximum(x_from, y_from) >= 0
            at, x, y, x_to, y_to = at[more], x[more], y[more], x_to[more], y_to[more]
        return best

    def valid(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the tokens of each pair may stand side by side in an encoding."""
        key = a << 20 | b
        slot = (key * 0x2545F4914F6CDD1D >> (64 - SLOTS)) & ((1 << SLOTS) - 1)
        out = self._flags[slot]
        miss = np.flatnonzero(self._known[slot] != key)
        if len(miss):
            new, which = np.unique(key[miss], return_inverse=True)
            fine = self.crossing(new >> 20, new & 0xFFFFF) < 0
            out[miss] = fine[which]
            slot = slot[miss]
            self._known[slot], self._flags[slot] = key[miss], out[miss]
            lost = self._known[slot] != key[miss]  # of two keys in one slot the last stays
            self._flags[slot[~lost]] = out[miss][~lost]
        return out


class Transducer:
    """Turns pre-tokens, as bytes, into token ids."""

    def __init__(self, merges: Merges):
        self.merges, self.window = merges, 4 * merges.lookahead
        self.widest = 0  # the most places that any pre-token took so far
        nodes: dict[bytes, int] = {b"": 0}
        for table in (merges.inner, merges.final):
            for token in table:
                for i in range(1, len(token) + 1):
                    nodes.setdefault(token[:i], len(nodes))
        edges = np.array([nodes[n[:-1]] << 8 | n[-1] for n in nodes if n], np.int64)
        order = np.argsort(edges)
        self._edges, self._targets = np.r_[edges[order], -1], np.r_[np.arange(1, len(nodes))[order], 0]
        # Of each state: the longest proper end of it that is a state, and the longest tokens that end it.
        self._fail = np.zeros(len(nodes), np.int64)
        self._fits = {False: np.full(len(nodes), -1), True: np.full(len(nodes), -1)}
        self._shorter = np.full(merges.size, -1)
        for node in sorted(nodes, key=len)[1:]:
            at, end = nodes[node], node[1:]
            while end not in nodes:
                end = end[1:]
            fail = self._fail[at] = nodes[end]
            for last, table in ((False, merges.inner), (True, merges.final)):
                token, shorter = table.get(node), self._fits[last][fail]
                self._fits[last][at] = shorter if token is None else token
                if token is not None:
                    self._shorter[token] = shorter

    def _step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The automaton's state after one more byte."""
        state, at = state.copy(), np.arange(len(state))
        out = np.zeros(len(state), np.int64)
        while len(at):
            key = state[at] << 8 | byte[at]
            place = np.searchsorted(self._edges[:-1], key)
            hit = self._edges[place] == key
            out[at[hit]] = self._targets[place[hit]]
            at = at[~hit & (state[at] > 0)]
            state[at] = self._fail[state[at]]
        return out

    def _last(self, held: np.ndarray, lane: np.ndarray, column: np.ndarray, state: np.ndarray, final: bool) -> np.ndarray:
        """The last token of each lane's prefix that ends at its column of ``held``, the tokens that end shorter prefixes."""
        token, todo = self._fits[final][state], np.arange(len(lane))
        while len(todo):
            fit = token[todo]
            if (fit < 0).any():
                raise ValueError("the vocabulary lacks a symbol")
            at = column[todo] - self.merges.length[fit]
            before = held[lane[todo], np.maximum(at, 0)].astype(np.int64)
            ok = (at >= 0) & (before < 0)
            check = np.flatnonzero((at >= 0) & (before >= 0))
            ok[check] = self.merges.valid(before[check], fit[check])
            todo = todo[~ok]
            token[todo] = self._shorter[token[todo]]
        return token

    def _path(self, held: np.ndarray, end: int) -> list[int]:
        """The tokens of a lane's prefix in the window."""
        out = []
        while end > 0:
            out.append(int(held[end]))
            end -= int(self.merges.length[out[-1]])
        return out[::-1]

    def _stable(self, held: np.ndarray, end: int) -> int:
        """The place of the node from which all prefixes in reach descend."""
        live = set(range(end - self.merges.lookahead + 1, end + 1))
        while len(live) > 1:
            top = max(live)
            live.remove(top)
            live.add(max(0, top - int(self.merges.length[held[top]])) if top else 0)
        return live.pop()

    def encode(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens one after the other, and the number of ids of each."""
        data, offsets = A.utf8(units)
        sizes = np.diff(offsets)
        order = np.argsort(-sizes, kind="stable")
        count = np.zeros(len(sizes), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at = 0
        while at < len(order) and sizes[order[at]] > 0:
            many = max(1, PLACES // (min(int(sizes[order[at]]), self.window) + 1))
            lanes = order[at : at + many]
            lanes = lanes[sizes[lanes] > 0]
            for lane, place, ids in self._together(data, offsets[lanes], sizes[lanes]):
                parts.append((lanes[lane], place, ids))
                np.maximum.at(count, lanes[lane], place + 1)
            at += many
        out = np.zeros(int(count.sum()), np.int64)
        first = np.cumsum(count) - count
        for lane, place, ids in parts:
            out[first[lane] + place] = ids
        return out, count

    def _together(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(lane, place, id) of the tokens of pre-tokens that are given from the longest to the shortest."""
        held = np.full((len(sizes), min(int(sizes[0]), self.window) + 1), -1, np.int32)
        state, base, emitted = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        every = np.arange(len(sizes))
        for end in range(1, int(sizes[0]) + 1):
            reach, inside = (int(np.searchsorted(-sizes, -x, "right")) for x in (end, end + 1))
            column = end - base[:reach]
            state[:reach] = self._step(state[:reach], data[starts[:reach] + end - 1].astype(np.int64))
            for lo, hi, final in ((0, inside, False), (inside, reach, True)):
                held[every[lo:hi], column[lo:hi]] = self._last(held, every[lo:hi], column[lo:hi], state[lo:hi], final)
            for lane in np.flatnonzero(column[:inside] == held.shape[1] - 1).tolist() if end >= self.window else []:
                row = held[lane]
                stable = self._stable(row, int(column[lane]))
                ids = self._path(row, stable)
                yield np.full(len(ids), lane), emitted[lane] + np.arange(len(ids)), np.array(ids, np.int64)
                emitted[lane] += len(ids)
                row[: len(row) - stable] = row[stable:].copy()
                base[lane] += stable
            if inside and (end + 1 - base[:inside]).max() >= held.shape[1]:
                held = np.pad(held, ((0, 0), (0, self.window)), constant_values=-1)
        self.widest = max(self.widest, held.shape[1])
        # Back from the ends; the places are known once the tokens are counted.
        lane, end, back = every, sizes - base, []
        while len(lane):
            token = held[lane, end].astype(np.int64)
            back.append((lane, token))
            end = end - self.merges.length[token]
            lane, end = lane[end > 0], end[end > 0]
        total = np.bincount(np.concatenate([b[0] for b in back]), minlength=len(sizes)) if back else np.zeros(len(sizes), np.int64)
        for i, (lane, token) in enumerate(back):
            yield lane, emitted[lane] + total[lane] - 1 - i, token


@dataclass
class Table:
    """What each token id gives when it is written out: its bytes, with a space after it where a gap may follow."""

    texts: pa.Array
    gaps: np.ndarray

    @classmethod
    def of(cls, texts: dict[int, bytes], gaps: Iterable[int]) -> Table:
        gap = np.zeros(max(texts) + 1, bool)
        gap[list(gaps)] = True
        return cls(pa.array([None if i not in texts else texts[i] + b" " * int(gap[i]) for i in range(len(gap))], pa.large_binary()), gap)

    @classmethod
    def numbers(cls, merges: Merges) -> Table:
        """The ids themselves in decimal, a space between."""
        return cls.of({i: str(i).encode() for i in merges.names}, merges.names)

    @classmethod
    def names(cls, merges: Merges) -> Table:
        """What a vocabulary without decoder gives: the tokens' names, a space between."""
        return cls.of({i: t.encode() for i, t in merges.names.items()}, merges.names)

    @classmethod
    def readable(cls, merges: Merges) -> Table:
        """The encoded text, a space after each pre-token."""
        back, special = {s: b for b, s in enumerate(byte_symbols())}, set(merges.specials.values())
        texts = {i: t.encode() if i in special else bytes(back[c] for c in t.removesuffix(END)) for i, t in merges.names.items()}
        return cls.of(texts, [i for i, t in merges.names.items() if t.endswith(END) or i in special])


@dataclass
class Decoder:
    """Token ids to text, some at a time; state: whether a gap is due, and the bytes of an unfinished character."""

    table: Table
    due: bool = False
    utf8: codecs.IncrementalDecoder = field(default_factory=lambda: codecs.getincrementaldecoder("utf-8")("replace"))

    def feed(self, ids: np.ndarray) -> str:
        """The text that is certain after these ids; ids without text are skipped."""
        ids = ids[(ids >= 0) & (ids < len(self.table.gaps))]
        found = self.table.texts.take(pa.array(ids))
        if found.null_count:
            ids, found = ids[found.is_valid().to_numpy(zero_copy_only=False)], found.drop_null()
        if not len(ids):
            return ""
        _, ends, text = found.buffers()
        size = int(np.frombuffer(ends, np.int64, 1, 8 * (found.offset + len(found)))[0])
        lead, self.due = b" " * self.due, bool(self.table.gaps[ids[-1]])
        return self.utf8.decode(lead + memoryview(text)[: size - self.due])

    def finish(self) -> str:
        """What is left of an unfinished character; the decoder is as new."""
        self.due = False
        return self.utf8.decode(b"", True)


def segments(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts, those beyond a block cut at ASCII white space, and the row of each segment."""
    sizes = np.diff(A.utf8(texts)[1])
    if not len(sizes) or sizes.max() <= BLOCK_BYTES:
        return texts, np.arange(len(texts))
    out: list[bytes] = []
    rows: list[int] = []
    for row, text in enumerate(texts):
        data, at = memoryview(text.as_buffer()).cast("B"), 0
        while at < len(data):
            end = min(at + BLOCK_BYTES, len(data))
            while end < len(data) and data[end] not in b"\t\n\v\f\r ":
                end += 1
            out.append(bytes(data[at:end]))
            rows.append(row)
            at = end
    return pa.array(out, pa.large_binary()).cast(pa.large_string()), np.array(rows, np.int64)


def gathered(values: np.ndarray, counts: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The values of groups, in the order of ``code``; groups lie one after the other in ``values``."""
    first, many = (np.cumsum(counts) - counts)[code], counts[code]
    return values[np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]


@dataclass
class Digest:
    """A text's tokens so far: their number, and digests of ids and decoded text."""

    numbers: Decoder
    names: Decoder
    count: int = 0
    held: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        self._ids, self._text = hashlib.sha256(), hashlib.sha256()

    def feed(self, ids: np.ndarray, hold: bool) -> None:
        self.count += len(ids)
        self._ids.update(self.numbers.feed(ids).encode())
        self._text.update(self.names.feed(ids).encode())
        if hold:
            self.held.append(ids)

    def row(self) -> tuple[int, str, str, np.ndarray]:
        self._text.update(self.names.finish().encode())
        return self.count, self._ids.hexdigest(), self._text.hexdigest(), np.concatenate(self.held) if self.held else np.zeros(0, np.int64)


class Encoder:
    """Encodes and decodes blocks of text."""

    def __init__(self, spec: dict):
        self.merges = Merges(spec)
        self.transducer = Transducer(self.merges)
        self.numbers, self.names = Table.numbers(self.merges), Table.names(self.merges)
        self._all, self._narrow = patterns()
        self._lowered = Lowering()
        self._specials = sorted(self.merges.specials, key=len, reverse=True)
        self._special = re.compile("|".join(map(re.escape, self._specials))) if self._specials else None

    def units(self, runs: str) -> list[str]:
        """Pre-tokens and marks of special tokens, in order, of runs that are separated by ``\\n``."""
        if self._special:
            runs = self._special.sub(lambda m: "\t" * (self._specials.index(m[0]) + 1) + "\v", runs)
        runs = self._lowered(runs)
        return (self._narrow if runs.isascii() or last_character(runs) < 1 << 16 else self._all).findall(runs)

    def runs(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of runs without white space one after the other, and the number of ids of each."""
        text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(runs)], pa.int64()), runs), pa.scalar("\n", pa.large_string()))[0].as_py()
        found = pa.array(self.units(text), pa.large_string()).dictionary_encode()
        units, code = found.dictionary, found.indices.to_numpy().astype(np.int64)
        mark = pc.starts_with(units, "\t").to_numpy(zero_copy_only=False)
        breaks = pc.equal(units, "\n").to_numpy(zero_copy_only=False)
        ids, count = self.transducer.encode(pc.if_else(pa.array(mark | breaks), pa.scalar("", pa.large_string()), units))
        if mark.any():
            special = np.array([self.merges.specials[self._specials[len(u) - 2]] for u in units.filter(pa.array(mark)).to_pylist()], np.int64)
            ids, count = np.insert(ids, (np.cumsum(count) - count)[mark], special), count + mark
        ends = breaks[code]
        run, code = np.cumsum(ends)[~ends], code[~ends]
        return gathered(ids, count, code), np.bincount(run, count[code], len(runs)).astype(np.int64)

    def texts(self, texts: pa.Array, hold: bool = False) -> list[tuple[int, str, str, np.ndarray]]:
        """Of each text: number of tokens, digest of the ids, digest of the decoded text and, if held, the ids."""
        out = [Digest(Decoder(self.numbers), Decoder(self.names)) for _ in range(len(texts))]
        parts, rows = segments(texts.cast(pa.large_string()).fill_null(""))
        for block in A.slices(pa.record_batch({"text": parts}), most=BLOCK_BYTES):
            split = pc.ascii_split_whitespace(block.column(0))
            owner = np.repeat(np.arange(len(split)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
            runs = split.flatten().dictionary_encode()
            mine, rows = rows[: len(split)], rows[len(split) :]
            if len(runs.dictionary):
                ids, count = self.runs(runs.dictionary)
                code = runs.indices.to_numpy().astype(np.int64)
                cuts = np.cumsum(np.bincount(owner, count[code], len(split)).astype(np.int64))
                for row, part in zip(mine.tolist(), np.split(gathered(ids, count, code), cuts[:-1]), strict=True):
                    if len(part):
                        out[row].feed(part, hold)
        return [d.row() for d in out]


def read_spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids; one row per row of ``docs``.

    ``path`` names the vocabulary file on the driver; its text, of a fixed size,
    goes to the tasks as a broadcast.  Null texts count as empty: no tokens and the
    digests of empty text.  Texts of any length pass block by block; only a run
    without white space is held whole.  Other columns are ignored; doc_ids may be
    null or repeated.
    """
    with open(path, "rb") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())][: 3 + with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(json.loads(spec.value))
            for part in A.slices(batch, most=BLOCK_BYTES):
                rows = encoder.texts(part.column(1), with_ids)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], names=names)
            A.release()
        encoder = None  # idle workers keep no tables
        A.release()

    types = ["long", "long", "string", "string", "array<int>"]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, types, strict=False)))
