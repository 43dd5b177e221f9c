"""BPE encoding and decoding by speculation and verification.

For the new words of a batch a greedy longest match over the vocabulary, run on all of them at once over a trie in
arrays, proposes tokens. A proposal is the exact encoding if merging by rank would never join the two tokens of any
adjacent pair; that depends on the pair alone, so a vectorised check tests all distinct pairs at once and remembers the
verdicts. Only words with a failing pair go through exact merging, lowest rank first, which runs on all failing words of
the batch at once as well. Texts are cut at spaces and line ends, which no word crosses; encoded pieces and words are kept in
stores of two generations for each task: when the younger is full it becomes the older, whose members come back when they
are met again.

Why a pair decides. Each token is the result of a fixed tree of merges, and merges run in the order of their ranks. At
the time of rank r the symbols at the two sides of a boundary are the nodes on the right edge of the left tree and on
the left edge of the right tree that exist then. The boundary is crossed if and only if some such pair of nodes has a
merge of a rank at which both are still there. The check walks both edges.

Decoding goes from the ids alone. The vocabulary file is a parameter (JSON of the tokenizers library: byte-level alphabet,
end-of-word suffix, split by a pattern, lower case). Text outside special tokens is normalised as the file says: NFC,
lower case, white space dropped by the pattern.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from phraseloom.llm.common import arrow_map, texts_of

#: Entries of a generation of a store at most, beyond one batch.
STORE_WORDS = 80_000
#: Texts that are cut into pieces at once.
TEXTS = 100
#: A rank beyond all ranks.
NEVER = 1 << 40
#: Bytes of a word up to which words are encoded together; longer ones go one by one.
TOGETHER = 64


def _byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 bytes stand for themselves, the rest follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(others)) for b in range(256)]


class NumberMap:
    """A fixed map of whole numbers to whole numbers, looked up for arrays at once: open addressing in two arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int) -> None:
        self.shift = np.uint64(64 - max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4)))))
        size = 1 << (64 - int(self.shift))
        self.mask, self.missing = size - 1, missing
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, missing, np.int64)
        keys, values = np.asarray(keys, np.int64), np.asarray(values, np.int64)
        at = self._place(keys)
        while len(keys):
            free = self.keys[at] < 0
            place, first = np.unique(np.where(free, at, -1), return_index=True)
            first = first[place >= 0]
            self.keys[at[first]], self.values[at[first]] = keys[first], values[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, values, at = keys[left], values[left], (at[left] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._place(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], self.missing)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            held = self.keys[at[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out


class Bpe:
    """An encoder and decoder for one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = dict(model["vocab"])
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (self.ids | self.specials).items()}
        self.names = [self.strings.get(i) for i in range(max(self.strings) + 1)]
        self.raw_names = [(s or "").encode() for s in self.names]
        self.alphabet = _byte_alphabet()
        self.byte_of = {c: b for b, c in enumerate(self.alphabet)}
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.split = regex.compile(pattern)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.cuttable = not any(" " in s or "\n" in s for s in self.specials)
        self._load_merges(model["merges"])
        self._load_trie()
        self.known: set[str] = set()  # characters met before that this Python's Unicode version has
        self.forget()
        self.seen, self.failed = 0, 0  # words proposed, and those of them that had to be merged

    def forget(self) -> None:
        """Empty the stores."""
        self.verdicts: dict[int, bool] = {}
        self.store: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})  # of pieces of text: younger, older
        self.words: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})

    def _load_merges(self, merges: list) -> None:
        size = max(self.ids.values()) + 1
        self.rank: dict[int, int] = {}  # of a pair of ids, as one number
        made: list[int] = []  # what the merge of each rank makes
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.born = np.full(size, -1, np.int64)  # the rank that makes a token; -1 for one symbol
        for k, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = self.ids[a], self.ids[b], self.ids[a + b]
            self.rank[(x << 20) | y] = k
            made.append(z)
            if self.left[z] < 0:
                self.left[z], self.right[z], self.born[z] = x, y, k
        self.made = np.array(made, np.int64)
        self.rank_of = NumberMap(np.array(list(self.rank), np.int64), np.array(list(self.rank.values()), np.int64), NEVER)
        # the id of each byte as a symbol inside a word, and 256 later as the last of one; -1 if the vocabulary lacks it
        self.symbol = np.array([self.ids.get(c + end, -1) for end in ("", self.suffix) for c in self.alphabet], np.int64)

    def _load_trie(self) -> None:
        """Tokens that exact merging would itself make of their own string (a proposal may use no other), as a trie over bytes."""
        self.usable: dict[str, int] = {}
        entries = []  # (token, its bytes, whether it ends a word)
        for s, i in self.ids.items():
            ends = bool(self.suffix) and s.endswith(self.suffix) and s != self.suffix
            body = s[: -len(self.suffix)] if ends else s
            if all(c in self.byte_of for c in body):
                entries.append((s, i, bytes([self.byte_of[c] for c in body]), ends))
        merged = self._merge_all([e[2] for e in entries], np.array([e[3] for e in entries], bool))
        nodes: dict[int, int] = {}
        plain, last = [-1], [-1]
        for (s, i, raw, ends), own in zip(entries, merged, strict=True):
            if own != np.uint32(i).tobytes():
                continue
            self.usable[s] = i
            at = 0
            for b in raw:
                key = (at << 8) | b
                at = nodes.get(key, -1)
                if at < 0:
                    at = nodes[key] = len(plain)
                    plain.append(-1)
                    last.append(-1)
            if ends or not self.suffix:
                last[at] = i
            if not ends:
                plain[at] = i
        self.step = NumberMap(np.array(list(nodes), np.int64), np.array(list(nodes.values()), np.int64), -1)
        self.plain, self.last = np.array(plain, np.int64), np.array(last, np.int64)

    def _symbols(self, piece: str) -> list[int] | None:
        """The single symbols of a piece of a word that may end in the suffix; None if one isn't in the vocabulary."""
        body = piece[: -len(self.suffix)] if self.suffix and piece.endswith(self.suffix) and piece != self.suffix else piece
        parts = list(body)
        if body is not piece:
            parts[-1] += self.suffix
        found = [self.ids.get(p) for p in parts]
        return None if not found or None in found else found

    def _merge(self, symbols: list[int]) -> list[int]:
        """Exact merging of one word: the pair of the lowest rank, leftmost first, until none is left."""
        out, rank, made = list(symbols), self.rank.get, self.made
        ranks = [rank((x << 20) | y, NEVER) for x, y in zip(out, out[1:], strict=False)]
        while ranks and (best := min(ranks)) < NEVER:
            k = ranks.index(best)
            out[k : k + 2] = [int(made[best])]
            del ranks[k]
            if k:
                ranks[k - 1] = rank((out[k - 1] << 20) | out[k], NEVER)
            if k < len(ranks):
                ranks[k] = rank((out[k] << 20) | out[k + 1], NEVER)
        return out

    def _merge_all(self, words: list[bytes], ends: np.ndarray) -> list[bytes]:
        """Exact merging of many words at once, as ids in bytes; ends: whether a word's last byte takes the suffix.

        Words of like length form a matrix; each round merges in every word its pair of the lowest rank, leftmost first.
        """
        out: list[bytes] = [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for low, high in ((1, 8), (9, 16), (17, 32), (33, TOGETHER)):
            at = np.flatnonzero((lengths >= low) & (lengths <= high))
            if len(at):
                length = lengths[at]
                codes = _matrix([words[k] for k in at.tolist()], length, high).astype(np.int64)
                codes[np.flatnonzero(ends[at]), length[ends[at]] - 1] += 256
                rows = np.where(np.arange(high) < length[:, None], self.symbol[codes], -1)
                rows, length = _packed(rows)  # symbols that the vocabulary lacks are left out, as the library does
                self._merge_rows(rows, length)
                for k, ids in zip(at.tolist(), _as_bytes(rows, length), strict=True):
                    out[k] = ids
        for k in np.flatnonzero(lengths > TOGETHER).tolist():
            codes = [b + 256 * (ends[k] and n == len(words[k]) - 1) for n, b in enumerate(words[k])]
            out[k] = np.array(self._merge([i for i in self.symbol[codes].tolist() if i >= 0]), "<u4").tobytes()
        return out

    def _merge_rows(self, rows: np.ndarray, length: np.ndarray) -> None:
        """Merge in place: rows of ids, of which the first length are used, the others -1."""
        columns = np.arange(rows.shape[1])
        pairs = columns[:-1][None, :] < (length - 1)[:, None]
        ranks = np.full((len(rows), max(1, rows.shape[1] - 1)), NEVER, np.int64)
        ranks[pairs] = self.rank_of((rows[:, :-1][pairs] << 20) | rows[:, 1:][pairs])
        live = np.arange(len(rows))
        while True:
            best = ranks.min(1)
            going = np.flatnonzero(best < NEVER)
            if not len(going):
                return
            if len(going) < len(live):
                live, ranks, best = live[going], ranks[going], best[going]
            k, own = ranks.argmin(1), rows[live]
            every = np.arange(len(live))
            after = columns[None, :] > k[:, None]
            own = np.where(after, np.concatenate([own[:, 1:], np.full((len(own), 1), -1)], 1), own)
            own[every, k] = self.made[best]
            rows[live] = own
            length[live] -= 1
            # the pair that merged is gone; those beside it are new
            ranks = np.where(after[:, :-1] | (columns[None, :-1] == k[:, None]), np.concatenate([ranks[:, 1:], np.full((len(ranks), 1), NEVER)], 1), ranks)
            for left in (k - 1, k):
                there = np.flatnonzero((left >= 0) & (left < length[live] - 1))
                at = left[there]
                ranks[there, at] = self.rank_of((own[there, at] << 20) | own[there, at + 1])

    def _propose(self, words: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy longest match for a matrix of words as bytes: ids, their number, and whether the whole word was matched.

        All words walk the trie at once; one that can't go on takes the longest token it has passed and starts anew behind
        it. The last token has to take the end-of-word suffix with it.
        """
        out, n = np.full(words.shape, -1, np.int64), np.zeros(len(words), np.int64)
        whole = np.ones(len(words), bool)
        live = np.flatnonzero(length > 0)
        at, node = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        best, best_end = np.full(len(words), -1, np.int64), np.zeros(len(words), np.int64)
        while len(live):
            place = at[live]
            inside = place < length[live]
            to = np.full(len(live), -1, np.int64)
            to[inside] = self.step((node[live[inside]] << 8) | words[live[inside], place[inside]])
            on = to >= 0
            moved = live[on]
            node[moved] = to[on]
            at[moved] += 1
            token = np.where(at[moved] == length[moved], self.last[to[on]], self.plain[to[on]])
            hit = moved[token >= 0]
            best[hit], best_end[hit] = token[token >= 0], at[hit]
            stuck = live[~on]
            none = best[stuck] < 0
            whole[stuck[none]] = False
            done = stuck[~none]
            out[done, n[done]] = best[done]
            n[done] += 1
            at[done], node[done], best[done] = best_end[done], 0, -1
            over = np.zeros(len(whole), bool)
            over[stuck[none]] = True
            over[done[at[done] == length[done]]] = True
            live = live[~over[live]]
        return out, n, whole

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of tokens, whether merging leaves the boundary between them; vectorised over the pairs."""
        good = np.ones(len(a), bool)
        x, x_gone = a.copy(), np.full(len(a), NEVER)  # a node of the left tree's right edge, and the rank that uses it up
        while (live := x >= 0).any():
            y, y_gone = b.copy(), np.full(len(b), NEVER)
            while (both := live & (y >= 0)).any():
                rank = np.where(both, self.rank_of((np.maximum(x, 0) << 20) | np.maximum(y, 0)), NEVER)
                # of equal ranks the leftmost merge goes first: the one that uses x up lies to the left, that of y to the right
                good &= ~(both & (rank < NEVER) & (rank < x_gone) & (rank <= y_gone))
                y_gone, y = self.born[np.maximum(y, 0)], np.where(both, self.left[np.maximum(y, 0)], -1)
            x_gone, x = self.born[np.maximum(x, 0)], np.where(live, self.right[np.maximum(x, 0)], -1)
        return good

    def _verdicts(self, pairs: np.ndarray) -> np.ndarray:
        """Whether each of the pairs holds; new ones are checked all at once."""
        distinct, back = np.unique(pairs, return_inverse=True)
        held = list(map(self.verdicts.get, distinct.tolist()))
        new = distinct[[h is None for h in held]]
        if len(new):
            if len(self.verdicts) > 4 * STORE_WORDS:
                self.verdicts.clear()
            found = self._compatible(new >> 20, new & ((1 << 20) - 1)).tolist()
            self.verdicts.update(zip(new.tolist(), found, strict=True))
            fresh = iter(found)
            held = [next(fresh) if h is None else h for h in held]
        return np.array(held, bool)[back]

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word: proposals that hold, exact merging for the others."""
        out: list[bytes | None] = [None] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for low, high in ((1, 8), (9, 16), (17, 32), (33, TOGETHER)):
            at = np.flatnonzero((lengths >= low) & (lengths <= high))
            if not len(at):
                continue
            rows, n, good = self._propose(_matrix([words[k] for k in at.tolist()], lengths[at], high).astype(np.int64), lengths[at])
            row, column = np.nonzero(np.arange(high - 1) < (n - 1)[:, None])
            if len(row):
                holds = self._verdicts((rows[row, column] << 20) | rows[row, column + 1])
                good[row[~holds]] = False
            kept = np.flatnonzero(good)
            for k, ids in zip(at[kept].tolist(), _as_bytes(rows[kept], n[kept]), strict=True):
                out[k] = ids
        failing = [k for k, ids in enumerate(out) if ids is None]
        self.seen += len(words)
        self.failed += len(failing)
        for k, ids in zip(failing, self._merge_all([words[k] for k in failing], np.full(len(failing), bool(self.suffix))), strict=True):
            out[k] = ids
        return out

    def _words(self, text: str) -> list[str]:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # lower case without regard to the place in a word
            fresh = set(text) - self.known
            if fresh:
                if any(unicodedata.category(c) == "Cn" for c in fresh):
                    return self._words_as_library(text)
                self.known |= fresh
        text = text.lower()
        return [text] if text.isalpha() else self.split.findall(text)  # letters alone are one word

    def _words_as_library(self, text: str) -> list[str]:
        """The words of a text with characters that this Python doesn't know: Unicode versions differ on their class."""
        from tokenizers import Regex, normalizers, pre_tokenizers

        cut = pre_tokenizers.Split(Regex(self.split.pattern), "removed", invert=True)
        return [w for w, _ in cut.pre_tokenize_str(normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str(text))]

    def _pieces_of(self, piece: str) -> list[str | bytes]:
        """The words of a piece of text; special tokens as the bytes of their ids."""
        if self.special is None or "<|" not in piece:
            return self._words(piece)
        out: list[str | bytes] = []
        at = 0
        for m in self.special.finditer(piece):
            out += self._words(piece[at : m.start()])
            out.append(np.array([self.specials[m[0]]], "<u4").tobytes())
            at = m.end()
        return out + self._words(piece[at:])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        cut = [t.replace("\n", " ").split(" ") for t in texts] if self.cuttable else [[t] for t in texts]
        wanted = set(chain.from_iterable(cut))
        store, new = _ready(self.store, wanted)
        self.store = store
        made = [self._pieces_of(piece) for piece in new]
        words, fresh = _ready(self.words, {w for own in made for w in own if isinstance(w, str)})
        self.words = words
        words[0].update(zip(fresh, self._encode_words([w.encode() for w in fresh]), strict=True))
        of = words[0]
        store[0].update((piece, b"".join([of[w] if isinstance(w, str) else w for w in own])) for piece, own in zip(new, made, strict=True))
        look = store[0].__getitem__
        return [b"".join(map(look, own)) for own in cut]

    def pieces(self, texts: list[str]) -> list[tuple[bytes, list[str]]]:
        """For each text its ids as little-endian bytes and the token strings."""
        return [(ids, [self.names[i] for i in np.frombuffer(ids, "<u4").tolist()]) for ids in self.encode_batch(texts)]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_batch([text])[0], "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The token strings joined by a space, as the library does for a file without a decoder; unknown ids give nothing."""
        return " ".join(self.strings[i] for i in ids if i in self.strings)

    def decode_raw(self, ids: bytes) -> bytes:
        """decode() of ids in bytes, all of which are known, as UTF-8."""
        return b" ".join(map(self.raw_names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _matrix(words: list[bytes], length: np.ndarray, width: int) -> np.ndarray:
    """Words as rows of bytes, filled up with zeros."""
    out = np.zeros((len(words), width), np.uint8)
    out[np.arange(width) < length[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    return out


def _packed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with all -1 moved to their ends, and the number of the others."""
    length = (rows >= 0).sum(1)
    inside = np.arange(rows.shape[1]) < length[:, None]
    out = np.full(rows.shape, -1, np.int64)
    out[inside] = rows[rows >= 0]
    return out, length


def _as_bytes(rows: np.ndarray, length: np.ndarray) -> list[bytes]:
    """The first length ids of each row as bytes."""
    flat = rows[np.arange(rows.shape[1]) < length[:, None]].astype("<u4").tobytes()
    ends = np.cumsum(length) * 4
    return [flat[a:b] for a, b in zip((ends - length * 4).tolist(), ends.tolist(), strict=True)]


def _ready(store: tuple[dict, dict], wanted: set) -> tuple[tuple[dict, dict], list]:
    """The store with those of wanted that it has in its younger generation, and the others."""
    young, old = store
    if len(young) > STORE_WORDS:
        young, old = {}, young
    new = []
    for w in wanted - young.keys():
        held = old.get(w)
        if held is None:
            new.append(w)
        else:
            young[w] = held
    return (young, old), new


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    return Bpe(path)


#: What encode_table() can return for each document, and the types.
OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encode_table(docs: DataFrame, path: str, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """doc_id and the named OUTPUTS of each row: one pass over the texts, no shuffle, and no rows lost.

    A null or empty text has no tokens. path is the vocabulary file, at the same place on each machine. decoded is what
    decoding gives for the ids.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe, texts = load(path), texts_of(batch)
        first = {t: k for k, t in reversed(list(enumerate(texts)))}  # equal texts are encoded once
        distinct = list(first)
        made = {t: ids for k in range(0, len(distinct), TEXTS) for t, ids in zip(distinct[k : k + TEXTS], bpe.encode_batch(distinct[k : k + TEXTS]), strict=True)}
        found = [made[t] for t in texts]
        decoded = [bpe.decode_raw(i) for i in found] if any(o.startswith("decoded") for o in outputs) else []
        make = {
            "n_tokens": lambda: pa.array([len(i) // 4 for i in found], pa.int64()),
            "ids": lambda: pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i in found], pa.list_(pa.int32())),
            "decoded": lambda: pa.array([d.decode() for d in decoded], pa.string()),
            "ids_sha256": lambda: pa.array([hashlib.sha256(i).hexdigest() for i in found], pa.string()),
            "decoded_sha256": lambda: pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string()),
        }
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *[make[o]() for o in outputs]], names=["doc_id", *outputs])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, " + ", ".join(f"{o} {OUTPUTS[o]}" for o in outputs), after=lambda: load(path).forget())


def decode_table(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, decoded) from the column ids; null ids decode to the empty text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([bpe.decode(i or []) for i in batch.column("ids").to_pylist()], pa.string())], names=["doc_id", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return arrow_map(encoded.select("doc_id", "ids"), run, f"doc_id {kind}, decoded string")
