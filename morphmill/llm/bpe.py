"""BPE encoding and decoding of whole texts with a public vocabulary, by prefix-sharing trie traversal.

Each task inserts the distinct new words of a batch into a trie of symbols and
walks it depth first. A node's state is the last token of its prefix's encoding:
a token t is the last one of a prefix p if t is a suffix of p and, with the last
token u of p without t, the two stay apart when u and t are encoded together. So
the encoding of a shared prefix is worked out once for all words below it, and a
word's encoding is read back along the states.

The vocabulary is that of a ``tokenizers`` JSON file with byte-level symbols,
word ends and lower-casing; its path is a parameter.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphmill.llm._text import slices

#: Encoded words kept by a worker, in two halves: when the newer one is full the older one is forgotten.
KEEP_WORDS = 200_000
#: Characters of the texts of one trie, and bytes that are taken out of a batch at a time.
TRIE_CHARS = 2_000_000


def byte_symbols() -> list[str]:
    """The printable character of each byte: itself if it is printable Latin-1, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in plain}
    for b in range(256):
        table.setdefault(b, chr(0x100 + len(table) - len(plain)))
    return [table[b] for b in range(256)]


class WordBpe:
    """Words to ids and ids to text, for one vocabulary file's content."""

    def __init__(self, content: str):
        spec = json.loads(content)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.end: str = spec["model"]["end_of_word_suffix"] or ""
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in spec["model"]["merges"])
        self.ranks = {pair: i for i, pair in enumerate(pairs)}
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.symbols = byte_symbols()
        self.byte_of = {c: b for b, c in enumerate(self.symbols)}
        self.names = {i: t for t, i in {**self.ids, **self.special}.items()}
        self.decimals = {str(i): t for i, t in self.names.items()}
        self.apart: dict[tuple[str, str], bool] = {}
        self.words, self.old_words = self._special_words(), {}
        #: The tokens that the merges really make, as a trie read from their last symbol backwards; None leads to the token.
        self.backward: dict = {}
        for token in self.ids:
            own = self._symbols_of(token)
            if len(own) == 1 or self._merged(own) == [token]:
                node = self.backward
                for symbol in reversed(own):
                    node = node.setdefault(symbol, {})
                node[None] = token

    def _special_words(self) -> dict[str, str]:
        """The special tokens: no other word of the pattern can be one of them."""
        return {w: str(i) for w, i in self.special.items()}

    def _symbols_of(self, token: str) -> tuple[str, ...]:
        """A token's single symbols; the last one carries the word end."""
        if self.end and token.endswith(self.end) and token != self.end:
            body = token[: -len(self.end)]
            return (*body[:-1], body[-1] + self.end)
        return tuple(token)

    def _merged(self, symbols: tuple[str, ...]) -> list[str]:
        """The merges in their order; for single tokens and pairs of tokens only."""
        own = list(symbols)
        while len(own) > 1:
            rank, i = min((self.ranks.get((own[i], own[i + 1]), len(self.ranks)), i) for i in range(len(own) - 1))
            if rank == len(self.ranks):
                break
            own[i : i + 2] = [own[i] + own[i + 1]]
        return own

    def _stay_apart(self, u: str, t: str) -> bool:
        found = self.apart.get((u, t))
        if found is None:
            found = self.apart[u, t] = self._merged((*self._symbols_of(u), *self._symbols_of(t))) == [u, t]
        return found

    def _last_token(self, path: list[str], states: list[tuple[str, int]]) -> tuple[str, int]:
        """The last token of the prefix ``path``, and its number of symbols, given its shorter prefixes' states."""
        n = at = len(path)
        node, found = self.backward, []
        while at and (node := node.get(path[at - 1])) is not None:
            at -= 1
            if (token := node.get(None)) is not None:
                found.append((token, n - at))
        for token, size in reversed(found):
            if size == n or self._stay_apart(states[n - size - 1][0], token):
                return token, size
        raise ValueError(f"no token ends with {path[-1]!r}")

    def learn(self, words: set[str]) -> None:
        """Encode new words, by a walk over their trie."""
        old, new = self.old_words, []
        if len(self.words) > KEEP_WORDS // 2:
            self.old_words = old = self.words
            self.words = self._special_words()
        for w in words:
            if w not in self.words:
                if w in old:
                    self.words[w] = old[w]
                else:
                    new.append(w)
        if len(self.apart) > 2 * KEEP_WORDS:
            self.apart.clear()
        root: dict = {}
        for word in new:
            own = [self.symbols[b] for b in word.encode()]
            own[-1] += self.end
            node = root
            for symbol in own:
                node = node.setdefault(symbol, {})
            node[None] = word
        path: list[str] = []
        states: list[tuple[str, int]] = []
        walk = [iter(root.items())]
        while walk:
            step = next(walk[-1], None)
            if step is None:
                walk.pop()
                if path:
                    path.pop()
                    states.pop()
                continue
            symbol, below = step
            if symbol is None:
                ids, at = [], len(path)
                while at:
                    token, size = states[at - 1]
                    ids.append(str(self.ids[token]))
                    at -= size
                self.words[below] = " ".join(reversed(ids))
                continue
            path.append(symbol)
            states.append(self._last_token(path, states))
            walk.append(iter(below.items()))

    def split(self, text: str) -> list[str]:
        """The words of a text; those of ``special`` as they are. White space goes."""
        if self.splitter is None or "<" not in text or not self.splitter.search(text):
            return self.pattern.findall(self._normal(text))
        words = []
        for part in self.splitter.split(text):
            words += [part] if part in self.special else self.pattern.findall(self._normal(part))
        return words

    @staticmethod
    def _normal(text: str) -> str:
        """NFC and lower case, character by character: no other letter decides how one is lower-cased."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def encode(self, texts: list[str]) -> list[str]:
        """Ids of each text as decimals joined by spaces."""
        split = [self.split(t) for t in texts]
        self.learn({w for ws in split for w in ws})
        known = self.words
        return [" ".join([known[w] for w in ws]) for ws in split]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces: the vocabulary's file names no decoder. Unknown ids are left out."""
        return " ".join(self.names[i] for i in ids if i in self.names)


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """The vocabulary file that the job has sent to the executors; a worker reads it once."""
    if path not in _loaded:
        with open(path, encoding="utf-8") as f:
            _loaded[path] = WordBpe(f.read())
    return _loaded[path]


def shipped(docs: DataFrame, path: str) -> str:
    """Send the vocabulary's file, some MB at most, to all executors; its name there."""
    docs.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    """(ids, texts) of a batch of (id, text), some of its rows at a time; a null is an empty text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    for i, j in slices(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), TRIE_CHARS):
        yield batch.column(0).slice(i, j - i), ["" if t is None else t for t in batch.column(1).slice(i, j - i).to_pylist()]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: its id and ``ids``, the text's ids as decimals joined by spaces.

    A null or empty text, or one of white space only, has no ids (an empty
    string). Null ids and repeated rows are returned as they are; other columns
    are not. An empty table gives an empty result.
    """
    name = shipped(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(SparkFiles.get(name))
        for batch in batches:
            for of, part in _parts(batch):
                yield pa.RecordBatch.from_arrays([of, pa.array(bpe.encode(part), pa.string())], ["id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, ids string").withColumnRenamed("id", id_col)


def _text(ids: str | None, names: dict[str, str]) -> str:
    """The text of ids, as decimals joined by spaces; unknown ids are left out."""
    return " ".join([names[i] for i in (ids or "").split() if i in names])


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: its id and ``text``, the decoded ids; null or empty ids decode to an empty text."""
    name = shipped(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = load(SparkFiles.get(name)).decimals
        for batch in batches:
            texts = [_text(ids, names) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    rows = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("string").alias("ids"))
    return rows.mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


def encode_and_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: its id, ``ids`` as in ``encode``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    Texts are encoded and what comes out is decoded again, in one pass over the
    batch; nulls and empty texts as in ``encode``.
    """
    name = shipped(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(SparkFiles.get(name))
        for batch in batches:
            for of, part in _parts(batch):
                own = bpe.encode(part)
                counts = [ids.count(" ") + 1 if ids else 0 for ids in own]
                of_ids = [hashlib.sha256(ids.encode()).hexdigest() for ids in own]
                of_text = [hashlib.sha256(_text(ids, bpe.decimals).encode()).hexdigest() for ids in own]
                arrays = [of, pa.array(own, pa.string()), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, ids string, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode_and_decode`` without the ids themselves."""
    return encode_and_decode(docs, path, id_col, text_col).drop("ids")
