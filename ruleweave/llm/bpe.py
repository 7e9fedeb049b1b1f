"""Operator 4: BPE encoding and decoding by forced boundaries.

A vocabulary holds a fixed set of byte pairs inside its tokens. Where two neighbouring bytes of a
word form none of these pairs, no merge can ever join them, so the word is cut there: fragments
are merged independently and their ids concatenated, exactly as if the whole word had been merged.

Decoding turns each id into its token again.

Null and empty texts give no ids and empty decoded text. Strings of special tokens in a text become
those tokens, as in the library. Merges follow the vocabulary's ranks, which have no ties. Rows with equal ids or texts are
encoded each for themselves. An empty table gives no rows. Very long texts are one slice each. Other columns of the input are never read, whatever their names.
"""

from __future__ import annotations

import array
import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweave.llm.common import slices

#: Entries of a worker's caches before they are emptied; longer keys aren't kept.
CACHE_ENTRIES, CACHE_KEY = 250_000, 48
_SUFFIX = "</w>"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class _Cache(dict):
    """A dictionary that makes missing entries. When full, it is emptied, but what it held is kept for one more filling."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= CACHE_KEY:
            if len(self) >= CACHE_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class ForcedBoundaryBpe:
    """Encoder and decoder of a lower-casing word BPE with end-of-word suffix, read from a tokenizers file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != _SUFFIX or spec["decoder"] is not None:
            raise ValueError("a BPE vocabulary with end-of-word suffix and no decoder is needed")
        self.library = Tokenizer.from_file(path)
        self.alphabet = byte_alphabet()
        vocab: dict[str, int] = model["vocab"]
        self.vocab = vocab
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        # The library's merges, for fragments that end a word and for those that don't.
        self.ending, self.inner = BPE(vocab, merges, end_of_word_suffix=_SUFFIX), BPE(vocab, merges)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.table = [self.tokens.get(i) for i in range(max(self.tokens) + 1)]
        inside = set()
        for t in vocab:
            own = t.removesuffix(_SUFFIX)
            inside.update(zip(own, own[1:]))
        self.joinable = inside
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        self.fragments: _Cache = _Cache(self._merge)
        self.chunks: _Cache = _Cache(self._chunk)

    def fragments_of(self, word: str) -> list[str]:
        """Cut a word, written in the byte alphabet, at every pair that no token holds."""
        out, begin = [], 0
        for i in range(1, len(word)):
            if (word[i - 1], word[i]) not in self.joinable:
                out.append(word[begin:i])
                begin = i
        out.append(word[begin:])
        return out

    def _merge(self, key: str) -> bytes:
        """Ids of a fragment as little-endian 32-bit integers; the key ends in a space if the fragment ends its word."""
        final = key[-1] == " "
        found = self.ending.tokenize(key[:-1]) if final else self.inner.tokenize(key)
        return b"".join([t.id.to_bytes(4, "little") for t in found])

    def _word(self, word: str) -> bytes:
        """Ids of one word in the byte alphabet."""
        cut = self.fragments_of(word)
        cut[-1] += " "
        return b"".join(map(self.fragments.__getitem__, cut))

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a stretch of normalised text without white space."""
        alphabet = self.alphabet
        if chunk.isascii() and chunk.isprintable() or all(c < "ɐ" and (c.isalpha() or c.isascii()) for c in chunk) and chunk.isprintable():
            words = ["".join([alphabet[b] for b in w.encode()]) for w in self.words.findall(chunk)]
        else:
            words = [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(chunk)]
        return b"".join(map(self._word, words))

    def normalise(self, text: str) -> str:
        """As the library does: composed, white space to one space, lower case. Plain Latin text takes a fast way."""
        plain = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        if plain.isascii() and plain.isprintable():
            return plain.lower()
        if plain.isprintable() and max(plain, default="") < "ɐ" and "İ" not in plain:
            return unicodedata.normalize("NFC", plain).lower()
        return self.library.normalizer.normalize_str(text)

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        parts = self.split_special.split(text) if "<|" in text else [text]
        ids = []
        for k, part in enumerate(parts):
            if k % 2:
                ids.append(self.special[part].to_bytes(4, "little"))
            else:
                ids += map(self.chunks.__getitem__, filter(None, self.normalise(part).split(" ")))
        return b"".join(ids)

    def encode(self, text: str | None) -> list[int]:
        return array.array("I", self.encode_bytes(text or "")).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by spaces, special ones too, as the library does where the file names no decoder. Unknown ids give nothing."""
        found = [self.table[i] if 0 <= i < len(self.table) else None for i in ids]
        return " ".join([t for t in found if t is not None])

    def decode_bytes(self, ids: bytes) -> str:
        """Of ids as encode_bytes gives them, all of them known."""
        return " ".join(map(self.table.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@functools.lru_cache(maxsize=2)
def coder_for(path: str) -> ForcedBoundaryBpe:
    """One coder for each Python worker, so that what it keeps serves later tasks too."""
    return ForcedBoundaryBpe(path)


def encode_decode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Encode each text and decode the ids again: n_tokens and digests; with_ids adds ids and decoded."""
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<bigint>, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_for(path)
        for batch in slices(batches, "text_"):
            encoded = [coder.encode_bytes(t or "") for t in batch.column("text_").to_pylist()]
            rows = [(i, coder.decode_bytes(i)) for i in encoded]
            out = [batch.column("key_"), pa.array([len(i) // 4 for i, _ in rows], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i, _ in rows], pa.string()), pa.array([hashlib.sha256(d.encode()).hexdigest() for _, d in rows], pa.string())]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                out += [pa.array([[int.from_bytes(i[k : k + 4], "little") for k in range(0, len(i), 4)] for i, _ in rows], pa.list_(pa.int64())), pa.array([d for _, d in rows], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(out, names)

    return docs.select(F.col(key).alias("key_"), F.col(text).alias("text_")).mapInArrow(run, schema)
