"""BPE encoding and decoding with the merges of a public tokenizer, exactly, in time linear in the text.

A word is encoded from left to right. An Aho-Corasick automaton of all tokens gives the longest token that begins at
each place; it is taken if it may stand after the token before it, that is if merging the two tokens' texts as one would
leave just these two; else the next shorter token that begins there is tried, and where none is left the token before is
taken back. Places from which the rest was found to be out of reach aren't entered again. Which pairs are compatible
follows from the merges: no merge that comes before their own may join across the border. The answers go to a table.

Decoding joins slices of one byte string of all tokens by a table of offsets, and a separator, as the tokenizer's decode.

A tokenizer is read from its file (``tokenizers`` JSON of the BPE kind with a word-end suffix; normalisation to NFC,
white space and lower case; a splitting pattern; the byte alphabet). Added tokens in a text are matched first, in the raw
text. A null text counts as empty: no tokens. Rows are independent, so nulls, ties and repeats in other columns don't matter.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.shared import bounded, tidy

#: Words whose tokens a worker remembers, and pairs whose compatibility it remembers.
WORDS_KEPT, PAIRS_KEPT = 120_000, 200_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes for themselves, the others for code points from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


def _known(spec: dict) -> None:
    """An error for a tokenizer file that asks for more than this encoder does."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    expected = [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
    if [(x["type"], x.get("pattern"), x.get("content")) for x in steps] != expected:
        raise ValueError("only NFC, white space as one blank and lower case are known as normalizer")
    kinds = [x["type"] for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    if kinds != ["Split", "ByteLevel"] or spec["model"].get("type") != "BPE":
        raise ValueError("only byte-level BPE of split words is known")
    if any(spec["model"].get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")):
        raise ValueError("an option of the model is not known")
    if any(x.get(k) for x in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens are known as plain strings only")


class Encoder:
    """The tokens of texts, by backtracking over longest matches."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _known(spec)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = [""] * (1 + max(max(self.vocab.values()), *added.values()))
        for text, i in (self.vocab | added).items():
            self.names[i] = text
        steps = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(steps).findall
        self.added = added
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")").split if added else None
        self.letters = dict(enumerate(byte_letters()))
        self._tables(model)
        self.kept: dict[str, str] = {}
        self.pairs: dict[int, bool] = {}

    def _tables(self, model: dict) -> None:
        """Merges as pairs of ids, each token's two halves, the automaton, and each token's next shorter beginning."""
        close = "\0"  # one symbol for the end of a word, in place of the suffix
        text = {i: (t.removesuffix(self.end) + close if t.endswith(self.end) else t) for t, i in self.vocab.items()}
        self.pair_rank: dict[tuple[int, int], int] = {}
        self.halves = [(i, i) for i in range(len(self.names))]
        rank = {i: -1 for i in text}
        self.order = [0] * len(self.names)
        for k, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.pair_rank[x, y] = z
            if rank[z] < 0:
                rank[z] = k
                self.halves[z] = (x, y)
        # the place of a token among all: symbols first, then by merge
        for place, i in enumerate(sorted(text, key=lambda i: (rank[i], i))):
            self.order[i] = place
        self.automaton = ahocorasick.Automaton()
        by_text = {}
        for i, t in text.items():
            if self.halves[i] == (i, i) or self._stable(i):
                self.automaton.add_word(t, (i, len(t)))
                by_text[t] = i
        self.automaton.make_automaton()
        self.shorter = [-1] * len(self.names)
        self.length = [0] * len(self.names)
        for t, i in by_text.items():
            self.length[i] = len(t)
            self.shorter[i] = next((by_text[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in by_text), -1)

    def _stable(self, token: int) -> bool:
        """Whether a token's own text encodes to it: its halves must be compatible until they merge."""
        a, b = self.halves[token]
        return self._joined_first(a, b, self.order[token])

    def _joined_first(self, a: int, b: int, limit: int) -> bool:
        """No merge before ``limit`` joins the tokens a and b across their border."""
        order, halves, ranks = self.order, self.halves, self.pair_rank
        while True:
            z = ranks.get((a, b))
            if z is not None and order[z] < limit:
                return False
            if order[a] > order[b]:
                limit = min(limit, order[a])
                if halves[a][0] == a:
                    return True
                a = halves[a][1]
            else:
                if halves[b][0] == b:
                    return True
                limit = min(limit, order[b] + 1)
                b = halves[b][0]

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b may stand side by side."""
        key = a << 32 | b
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            got = self.pairs[key] = self._joined_first(a, b, 1 << 60)
        return got

    def encode_word(self, word: str) -> list[int]:
        """Token ids of one word of the splitting pattern."""
        letters = self.letters
        symbols = "".join([letters[b] for b in word.encode()]) + "\0"
        size = len(symbols)
        longest = [-1] * size
        for last, (token, n) in self.automaton.iter(symbols):
            longest[last - n + 1] = token  # ends ascend, so the longest comes last
        out: list[int] = []
        barred = set()
        at, token = 0, longest[0]
        while True:
            before = out[-1] if out else -1
            while token >= 0:
                to = at + self.length[token]
                if to not in barred and (before < 0 or self.compatible(before, token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at = to
                if at == size:
                    return out
                token = longest[at]
            else:
                barred.add(at)
                if not out:
                    raise ValueError(f"no tokens for {word!r}")
                token = out.pop()
                at -= self.length[token]
                token = self.shorter[token]

    def forget(self) -> None:
        """Gives back what was remembered of words and pairs: a worker outlives its tasks."""
        self.kept.clear()
        self.pairs.clear()

    def _word(self, word: str) -> str:
        got = self.kept.get(word)
        if got is None:
            if len(self.kept) >= WORDS_KEPT:
                self.kept.clear()
            got = self.kept[word] = " ".join(map(str, self.encode_word(word)))
        return got

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower-cased letter by letter: no final form
        kept, one = self.kept, self._word
        return [kept[w] if w in kept else one(w) for w in self.words(text.lower())]

    def encode(self, text: str | None) -> str:
        """Decimal ids of a text, joined by spaces."""
        if not text:
            return ""
        if self.split_added is None or "<|" not in text and not any(a in text for a in self.added):
            return " ".join(self._plain(text))
        out: list[str] = []
        for part in self.split_added(text):
            out += [str(self.added[part])] if part in self.added else self._plain(part)
        return " ".join(out)


class Decoder:
    """Texts of token ids, by a table of offsets into all tokens' bytes."""

    def __init__(self, names: list[str], separator: str = " "):
        parts = [(n + separator).encode() for n in names]
        self.separator = len(separator.encode())
        self.offsets = np.cumsum([0, *map(len, parts)])
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        size = self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(size)
        where = np.arange(ends[-1]) + np.repeat(self.offsets[ids] - ends + size, size)
        return self.bytes[where].tobytes()[: -self.separator or None]


@functools.lru_cache(maxsize=2)
def codec(path: str) -> tuple[Encoder, Decoder]:
    """A worker's encoder and decoder of a tokenizer file."""
    e = Encoder(path)
    return e, Decoder(e.names)


def encode(docs: DataFrame, path: str, text: str = "text", column: str = "token_ids") -> DataFrame:
    """``docs`` with the token ids of each row's text added as an array of ints."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, _ = codec(path)
        for b in batches:  # small ones: a batch's ids take more room than its text
            ids = [np.array(e.encode(x).split(), np.int32) for x in b.column(names.index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*names, column])
        e.forget()

    return bounded(docs).mapInArrow(tidy(run, codec), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{column}` array<int>")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Each row's ``doc_id, n_tokens, ids_sha256, decoded_sha256``: encoded, its ids read again, and decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, d = codec(path)
        for b in batches:
            n, ids_hash, text_hash = [], [], []
            for x in b.column(1):
                said = e.encode(x.as_py())
                ids = np.array(said.split(), np.int64)
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(said.encode()).hexdigest())
                text_hash.append(hashlib.sha256(d.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        e.forget()

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return bounded(thin).mapInArrow(tidy(run, codec), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
