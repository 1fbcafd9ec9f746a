"""Byte-pair encoding of whole texts, run by run: exact ids, and a prefix dynamic programme for exact counts.

The pre-tokenizer cuts a text into runs (letters, one number, other signs, clitics) that encode independently of each
other. So a batch of texts is cut with array operations on its bytes, its runs are dictionary-encoded by Arrow, each
distinct run is encoded once, and the results are gathered back in order; Python touches distinct runs only.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

from stratalog.llm.common import memory_of

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Memory of one generation of a memo, of which a worker keeps two; an entry's own size counts with ENTRY_BYTES.
MEMO_BYTES, ENTRY_BYTES = 16 << 20, 160
#: States of prefixes and pairs of tokens kept before their memory is emptied.
PREFIX_STATES, PAIRS = 600_000, 1_000_000
#: Runs and prefixes beyond it aren't kept.
LONG_WORD = 64
#: Texts are worked through together in slices of about so many bytes, cut behind ASCII white space.
SLICE_BYTES = 4 << 20

# The normalizer and pre-tokenizer that the run cutter implements.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_ASCII_SPACE = re.compile(rb"[ \t\n\x0b\x0c\r]")
_UNICODE_SPACE = re.compile("([\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000])")

#: Characters below it, of at most two bytes, are cut by arrays; words with others are the library's.
KNOWN = 0x180
SPACE, LETTER, NUMBER, OTHER = range(4)


def _kind(c: int) -> int:
    if c in (*range(9, 14), 32, 0x85, 0xA0):
        return SPACE
    return {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER)


_KINDS = np.array([_kind(c) for c in range(KNOWN)], np.uint8)
_LOWERS = np.array([ord(low) if len(low := chr(c).lower()) == 1 and ord(low) < KNOWN else 0 for c in range(KNOWN)], np.uint16)
#: Characters among them whose lower case isn't one of them.
_ODD = _LOWERS == 0
_ODD[0] = False
_BYTE_KIND = np.full(256, OTHER, np.uint8)
_BYTE_KIND[:128] = _KINDS[:128]
_BYTE_LOWER = np.arange(256, dtype=np.uint8)
_BYTE_LOWER[:128] = _LOWERS[:128]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[*range(9, 14), 32]] = True
_CLITIC_2 = np.zeros(256, bool)
_CLITIC_2[list(b"stmd")] = True
_CLITIC_3 = (b"re", b"ve", b"ll")

#: The byte alphabet: bytes that print stand for themselves, the others for characters from 256 on, in order.
_PRINTS = [*range(33, 127), *range(161, 173), *range(174, 256)]
_UNITS = np.arange(256, dtype="<u2")
_UNITS[[b for b in range(256) if b not in _PRINTS]] = np.arange(256, 512 - len(_PRINTS))
_UNITS[32] = 32


def word_bpe(path: str) -> "WordBpe":
    """The worker's own tokenizer for ``path``, loaded once, and kept until the worker turns to another operator."""
    kept = memory_of("bpe")
    if path not in kept:
        kept[path] = WordBpe(path)
    return kept[path]


def slices(data: bytes) -> Iterator[bytes]:
    at = 0
    while len(data) - at > SLICE_BYTES and (cut := _ASCII_SPACE.search(data, at + SLICE_BYTES)):
        yield data[at : cut.end()]
        at = cut.end()
    yield data[at:] if at else data


class _Memo:
    """Results by run in two generations, each bounded in bytes: what nobody asks for while the younger fills up leaves with the older."""

    def __init__(self, make: Callable[[list[bytes]], list[bytes]]):
        self.make, self.young, self.old, self.size = make, {}, {}, 0

    def all(self, keys: list[bytes]) -> list[bytes]:
        out = list(map(self.young.get, keys))
        fresh = [i for i, v in enumerate(out) if v is None]
        if fresh:
            for i in fresh:
                out[i] = self.old.get(keys[i])
            wanted = [i for i in fresh if out[i] is None]
            for i, got in zip(wanted, self.make([keys[i] for i in wanted])):
                out[i] = got
            for i in fresh:
                key, got = keys[i], out[i]
                if len(key) <= LONG_WORD:
                    self.young[key] = got
                    self.size += len(key) + len(got) + ENTRY_BYTES
                    if self.size > MEMO_BYTES:
                        self.old, self.young, self.size = self.young, {}, 0
        return out


def in_alphabet(run: bytes) -> str:
    """Bytes in the byte alphabet; spaces, which no run holds, stay."""
    return run.decode() if run.isascii() and run.decode().isprintable() else _UNITS[np.frombuffer(run, np.uint8)].tobytes().decode("utf-16-le")


class WideStep(ValueError):
    """A prefix count that jumps by more than a signed byte holds."""


class WordBpe:
    """A BPE vocabulary over a byte alphabet, read from a ``tokenizers`` JSON file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.wide = max(*model["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", [])), 0) > 0xFFFF
        cutters = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.known = (spec.get("normalizer") or {}).get("normalizers") == NORMALIZERS and cutters[0].get("pattern") == {"Regex": PATTERN} and [c.get("type") for c in cutters] == ["Split", "ByteLevel"]
        marks = sorted({s.encode()[:2] for s in self.special})
        self.marks = [np.frombuffer(m, np.uint8) for m in marks]
        odd = [re.escape(chr(c).encode()) for c in np.flatnonzero(_ODD)]
        self.strange = re.compile(b"|".join([b"[\xc6-\xff]", *odd, *map(re.escape, marks)]) if self.known else b"")
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._ids = _Memo(self.run_ids)
        self._steps = {w: _Memo(lambda runs, w=w: [self.run_steps(run, w) for run in runs]) for w in (1, 4)}
        self._states: dict[str, tuple[str, int, int]] = {}
        self._pairs: dict[tuple[str, str], bool] = {}
        self._splits: dict[str, tuple[str, str, int] | None] = {}
        self._spines: dict[tuple[str, int], list[tuple[str, float]]] = {}

    # -- tables that only the prefix counts need; workers that make ids never hold them ------------------------

    @cached_property
    def _model(self) -> dict:
        with open(self.path, encoding="utf-8") as f:
            return json.load(f)["model"]

    @cached_property
    def vocab(self) -> dict[str, int]:
        return self._model["vocab"]

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.vocab))

    @cached_property
    def ranks(self) -> dict[tuple[str, str], int]:
        return {tuple(m.split(" ")) if isinstance(m, str) else tuple(m): i for i, m in enumerate(self._model["merges"])}

    @cached_property
    def makers(self) -> dict[str, list[tuple[int, str, str]]]:
        made: dict[str, list[tuple[int, str, str]]] = {}
        for (a, b), rank in self.ranks.items():
            made.setdefault(a + b, []).append((rank, a, b))
        return made

    # -- cutting -----------------------------------------------------------------------------------------------

    def cut(self, raw: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Distinct runs of the bytes, each run's place among them, and where it begins.

        ``raw`` ends with two line feeds. Words (between ASCII white space) with a character beyond the known ones, or
        with the first signs of a special string, are runs as they stand; all others are cut and lower-cased as the
        normalizer and pre-tokenizer do.
        """
        kind, low = _BYTE_KIND[raw], _BYTE_LOWER[raw]
        lead = np.flatnonzero(raw >= 0xC0)
        odd = lead[raw[lead] >= 0xC6]
        if len(lead):
            at = lead[raw[lead] < 0xC6]
            code = (raw[at].astype(np.int32) & 31) << 6 | (raw[at + 1] & 63)
            kind[at] = kind[at + 1] = _KINDS[code]
            lower = _LOWERS[code]
            low[at], low[at + 1] = 0xC0 | lower >> 6, 0x80 | lower & 63
            odd = np.concatenate([odd, at[_ODD[code]]])
        for mark in self.marks:
            odd = np.concatenate([odd, np.flatnonzero((raw[:-1] == mark[0]) & (raw[1:] == mark[-1]) if len(mark) > 1 else raw == mark[0])])
        n = len(raw)
        new = np.ones(n + 1, bool)
        np.not_equal(kind[1:], kind[:-1], out=new[1:n])
        new[:n] |= (kind == NUMBER) & (raw & 0xC0 != 0x80)
        quote = np.flatnonzero(raw == 39)
        if len(quote):
            quote = quote[(quote == 0) | (kind[quote - 1] != OTHER)]
            a, b = low[quote + 1], low[quote + 2]
            short = quote[_CLITIC_2[a]]
            long = quote[np.logical_or.reduce([(a == x) & (b == y) for x, y in _CLITIC_3])]
            new[short + 1] = new[long + 1] = new[long + 2] = False
            new[short + 2] = new[long + 3] = True
        if not self.known:
            odd = np.flatnonzero(~_IS_SPACE[raw])
        if len(odd):
            space = np.flatnonzero(_IS_SPACE[raw])
            before = np.searchsorted(space, odd)
            first = np.unique(np.where(before > 0, space[before - 1] + 1, 0))
            last = space[np.searchsorted(space, first)]
            inside = np.zeros(n, np.int8)
            inside[first] = 1
            inside[last] = -1
            inside = np.cumsum(inside, dtype=np.int8).view(bool)
            kind[inside], low[inside], new[:n][inside] = OTHER, raw[inside], False
            new[first] = new[last] = True
        at = np.flatnonzero(new)
        begin, size = at[:-1], np.diff(at)
        real = kind[begin] != SPACE
        begin, size = begin[real], size[real]
        offsets = np.zeros(len(size) + 1, np.int32)
        np.cumsum(size, out=offsets[1:])
        runs = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(low[kind != SPACE])]).dictionary_encode()
        return runs.dictionary.to_pylist(), runs.indices.to_numpy(), begin

    def _gathered(self, memo: _Memo, width: int, texts: list[str], by_place: bool) -> list[bytes]:
        """For each text its runs' results of ``width`` bytes an element, one after another, or each at its code point's place."""
        made: list[list[bytes]] = [[] for _ in texts]
        units, size = [], 0
        for i, text in enumerate(texts):
            for part in slices(text.encode()):
                units.append((i, part))
                size += len(part) + 1
                if size >= SLICE_BYTES:
                    self._gather(memo, width, units, by_place, made)
                    units, size = [], 0
        if units:
            self._gather(memo, width, units, by_place, made)
        return [m[0] if len(m) == 1 else b"".join(m) for m in made]

    def _gather(self, memo: _Memo, width: int, units: list[tuple[int, bytes]], by_place: bool, made: list[list[bytes]]) -> None:
        raw = np.frombuffer(b"\n".join([u for _, u in units]) + b"\n\n", np.uint8)
        starts = np.cumsum([0, *(len(u) + 1 for _, u in units)])
        runs, codes, begin = self.cut(raw)
        results = memo.all(runs)
        kind = np.dtype(f"<u{width}")
        flat = np.frombuffer(b"".join(results), kind)
        sizes = np.fromiter(map(len, results), np.int64, len(results)) // width
        size = sizes[codes]
        ends = np.cumsum(size)
        source = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - (np.cumsum(sizes) - sizes)[codes], size)
        if by_place:
            point = np.cumsum(raw & 0xC0 != 0x80, dtype=np.int64) - 1
            out = np.zeros(int(point[-1]) + 1, kind)
            out[np.arange(len(source)) + np.repeat(point[begin] - (ends - size), size)] = flat[source]
            cuts = point[starts]
            less = 1
        else:
            out = flat[source]
            cuts = np.concatenate([[0], ends])[np.searchsorted(begin, starts)]
            less = 0
        for (i, _), a, b in zip(units, cuts.tolist(), cuts[1:].tolist()):
            made[i].append(out[a : b - less].tobytes())

    def strange_run(self, run: bytes) -> bool:
        return not self.known or self.strange.search(run) is not None

    # -- ids ---------------------------------------------------------------------------------------------------

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; exactly those of the library."""
        return self._gathered(self._ids, 4, texts, False)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    @cached_property
    def _by_run(self) -> object:
        """The same model behind a cutter at spaces, which the byte alphabet lacks, for many runs in one call."""
        from tokenizers import Tokenizer, pre_tokenizers

        made = Tokenizer(self.tokenizer.model)
        made.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        return made

    def run_ids(self, runs: list[bytes]) -> list[bytes]:
        joined = b" ".join(runs)
        strange = set()
        if self.strange_run(joined):
            strange = {i for i, run in enumerate(runs) if self.strange_run(run)}
            joined = b" ".join([run for i, run in enumerate(runs) if i not in strange])
        out: list[bytes] = []
        if joined:
            units = np.frombuffer(joined, np.uint8)
            got = self._by_run.encode(_UNITS[units].tobytes().decode("utf-16-le"), add_special_tokens=False)
            ids = np.array(got.ids, "<u4").tobytes()
            ends = (4 * np.cumsum(np.bincount(np.array(got.word_ids, np.int64)))).tolist()
            out = [ids[a:b] for a, b in zip([0, *ends], ends)]
        if strange:
            plain = iter(out)
            out = [np.array(self.tokenizer.encode(run.decode(), add_special_tokens=False).ids, "<u4").tobytes() if i in strange else next(plain) for i, run in enumerate(runs)]
        return out

    @cached_property
    def whole_tokens(self) -> set[str]:
        """The vocabulary's tokens that their own strings encode to."""
        return {t for t in self.vocab if self.is_whole(t)}

    @cached_property
    def inner_tokens(self) -> set[str]:
        return {t for t in self.whole_tokens if not t.endswith(self.end)} if self.end else self.whole_tokens

    @cached_property
    def end_tokens(self) -> set[str]:
        return {t[: -len(self.end)] for t in self.whole_tokens if t.endswith(self.end)} if self.end else self.whole_tokens

    # -- prefix counts -----------------------------------------------------------------------------------------

    def prefix_steps_all(self, texts: list[str]) -> list[tuple[bytes, int]]:
        """Per text one signed integer per code point, and how many bytes each has (1, or 4 if one needs it): how many tokens that code point adds.

        The running sum up to any position is the exact token count of that prefix of the text.
        """
        try:
            return [(s, 1) for s in self._gathered(self._steps[1], 1, texts, True)]
        except WideStep:
            if len(texts) > 1:
                return [self.prefix_steps(t) for t in texts]
            return [(s, 4) for s in self._gathered(self._steps[4], 4, texts, True)]

    def prefix_steps(self, text: str) -> tuple[bytes, int]:
        return self.prefix_steps_all([text])[0]

    def run_steps(self, run: bytes, width: int) -> bytes:
        """What each code point of a run adds to the count."""
        counts = self.word_counts(run.decode()) if self.strange_run(run) else self.known_counts(run)
        try:
            return b"".join([(b - a).to_bytes(width, "little", signed=True) for a, b in zip([0, *counts], counts)])
        except OverflowError as error:
            raise WideStep from error

    def known_counts(self, run: bytes) -> list[int]:
        """Token counts of a run's prefixes, by code points."""
        if run[:1] == b"'" and run[1:].isalpha():
            # what begins like a clitic of three signs is a quote and a letter before its end
            quote, whole = self.run_prefix_counts("'")[0], self.run_prefix_counts(run.decode())[-1]
            return [quote, *([quote + self.run_prefix_counts(run[1:2].decode())[0]] if len(run) == 3 else []), whole]
        counts = self.run_prefix_counts(in_alphabet(run))
        if run.isascii():
            return counts
        return [c for c, after in zip(counts, [*run[1:], 0]) if after & 0xC0 != 0x80]

    def word_counts(self, word: str) -> list[int]:
        """Exact token count of every non-empty prefix of any word, by code points."""
        out: list[int] = []
        base = 0
        pieces = self.specials.split(word) if self.specials else [word]
        for text, special in zip(pieces[::2], [*pieces[1::2], ""]):
            # a special string counts as ordinary signs until it is whole
            counts = self.plain_counts(text + special[:-1]) if text or special else []
            out += [base + c for c in counts]
            base += counts[len(text) - 1] if text else 0
            if special:
                base += 1
                out.append(base)
        return out

    def plain_counts(self, text: str) -> list[int]:
        """The same for text without special strings."""
        out: list[int] = []
        for piece in _UNICODE_SPACE.split(text):
            base = out[-1] if out else 0
            if piece and (_UNICODE_SPACE.fullmatch(piece) and self.known):
                out.append(base)
            elif piece:
                out += [base + c for c in self._piece_counts(piece)]
        return out

    def _piece_counts(self, piece: str) -> list[int]:
        if self.known:
            # only where each code point becomes one do prefixes of the piece stay prefixes of its pre-tokens
            normal = self.tokenizer.normalizer.normalize_str(piece)
            runs = [run for run, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
            if len(normal) == len(piece) and normal == "".join(map(str.lower, piece)) and len("".join(runs)) == len(normal.encode()):
                by_byte: list[int] = []
                for run in runs:
                    before = by_byte[-1] if by_byte else 0
                    clitic = run[:1] == "'" and run[1:].isascii() and run[1:].isalpha()
                    counts = self.known_counts(run.encode()) if clitic else self.run_prefix_counts(run)
                    by_byte += [before + c for c in counts]
                return [by_byte[e - 1] for e in np.cumsum([len(c.encode()) for c in normal]).tolist()]
        return [len(e.ids) for e in self.tokenizer.encode_batch([piece[: i + 1] for i in range(len(piece))], add_special_tokens=False)]

    def run_prefix_counts(self, run: str) -> list[int]:
        """The dynamic programme over one pre-token of byte symbols.

        A token sequence is the encoding of its string exactly when each two neighbours encode to themselves, so the
        last token of every prefix follows from the last tokens of shorter prefixes; counts add one per token.
        Inner prefixes end without the word-end mark; each prefix taken as a word of its own ends with it. What holds
        for a prefix holds in every run that begins with it, so the states are kept by prefix.
        """
        if len(self._states) > PREFIX_STATES:
            self._states.clear()
        states, pairs, fits, end = self._states, self._pairs, self.fits, self.end
        inner_tokens, end_tokens = self.inner_tokens, self.end_tokens
        last, inner, closed = [""], [0], []
        for k in range(1, len(run) + 1):
            state = states.get(run[:k])
            if state is None:
                found = ended = -1
                token = ""
                for i in range(k - 1, max(0, k - self.longest) - 1, -1):
                    piece = run[i:k]
                    if found < 0 and piece in inner_tokens and (i == 0 or (ok := pairs.get((last[i], piece))) or ok is None and fits(last[i], piece)):
                        found, token = i, piece
                        if ended >= 0:
                            break
                    if ended < 0 and piece in end_tokens and (i == 0 or (ok := pairs.get((last[i], piece + end))) or ok is None and fits(last[i], piece + end)):
                        ended = i
                        if found >= 0:
                            break
                if found < 0 or ended < 0:
                    raise ValueError(f"no encoding for {run[:k]!r}")
                state = token, inner[found] + 1, inner[ended] + 1
                if k <= LONG_WORD:
                    states[run[:k]] = state
            last.append(state[0])
            inner.append(state[1])
            closed.append(state[2])
        return closed

    def symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def split_of(self, token: str) -> tuple[str, str, int] | None:
        """The last merge that makes a token out of its own string: left, right, rank. None for single symbols and tokens nothing makes."""
        if token not in self._splits:
            self._splits[token] = next(((a, b, r) for r, a, b in self.makers.get(token, ()) if self.is_whole(a) and self.is_whole(b) and self._fits(self.spine(a, -1), self.spine(b, 0), True)), None)
        return self._splits[token]

    def is_whole(self, token: str) -> bool:
        """Whether a token's own string encodes to it."""
        return len(self.symbols(token)) == 1 or self.split_of(token) is not None

    def spine(self, token: str, side: int) -> list[tuple[str, float]]:
        """From the symbol at the token's edge (-1: last, 0: first) up to the token: each part and the rank that merges it."""
        got = self._spines.get((token, side))
        if got is None:
            split = self.split_of(token)
            if split is None:
                got = [(token, float("inf"))]
            else:
                below = self.spine(split[1 if side else 0], side)
                got = [*below[:-1], (below[-1][0], split[2]), (token, float("inf"))]
            self._spines[token, side] = got
        return got

    def fits(self, left: str, right: str) -> bool:
        """Whether the two tokens side by side encode to themselves: no merge across their border comes before theirs."""
        got = self._pairs.get((left, right))
        if got is None:
            if len(self._pairs) > PAIRS:
                self._pairs.clear()
            got = self._pairs[left, right] = self._fits(self.spine(left, -1), self.spine(right, 0))
        return got

    def _fits(self, lefts: list, rights: list, below: bool = False) -> bool:
        """below: leave out the merge of the two whole tokens."""
        top = float("inf")
        i = j = 0
        while True:
            (x, x_rank), (y, y_rank) = lefts[i], rights[j]
            if below and x_rank == y_rank == top:
                return True
            across = self.ranks.get((x, y))
            # equal ranks merge from left to right: the left token's own merge first, the border before the right's
            if across is not None and across < x_rank and across <= y_rank:
                return False
            if x_rank <= y_rank:
                if x_rank == top:
                    return True
                i += 1
            else:
                j += 1
