"""Byte-level BPE: encoding by tree concatenation, and decoding.

A text is cut into halves down to leaves, leaves are encoded on their own (leaves of very long documents in parallel
tasks), and at each join a window around it is encoded again and grown until its ids agree with those of both sides.

Defined results: null text counts as empty and gives no ids; equal rows give equal results, once per row; columns
other than the id and the text are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import text_batches, tidied

VOCABULARY = "byte_bpe_50k.json"
#: Leaves of documents, in characters: longer documents are spread over tasks.
DOCUMENT_LEAF = 1 << 15
#: Leaves of stretches that the pre-tokenizer leaves whole, in characters.
STRETCH_LEAF = 256
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Ids on either side of a join that are encoded again at first.
WINDOW = 16


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    table = byte_of_char()
    ids = dict(spec["model"]["vocab"]) | {x["content"]: x["id"] for x in spec["added_tokens"]}
    out = [b""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        out[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
    return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process: building it takes longer than encoding many texts."""
    return Encoder(path)


class Encoder:
    """Encodes whole texts to little-endian unsigned 32-bit ids.

    Where the vocabulary's ids are in the order of its merges, the merges run in an engine that goes by rank; it gives
    the ids of the tokenizers library in less time. Other vocabularies run in that library itself."""

    def __init__(self, path: str, stretch_leaf: int = STRETCH_LEAF):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.bytes = token_bytes(path)
        self.lengths = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.parts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pre = regex.compile(PRE_TOKENS)
        self.leaf = stretch_leaf
        self.longest_special, self.recoded = max(map(len, self.special), default=1), 0
        vocab = spec["model"]["vocab"]
        merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["model"]["merges"]]
        if merged == list(range(256, 256 + len(merged))):
            import tiktoken

            own = {b: i for i, b in enumerate(self.bytes) if i not in self.special.values()}
            self.merge = tiktoken.Encoding("ranks", pat_str=PRE_TOKENS, mergeable_ranks=own, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            self.merge = lambda text: tok.encode(text, add_special_tokens=False).ids

    def encode_many(self, texts: list[str]) -> list[bytes]:
        return [array("I", self.ids(t)).tobytes() for t in texts]

    def ids(self, text: str) -> list[int]:
        """Special tokens first, as the library takes them; then what stands between."""
        if not any(s in text for s in self.special):
            return self._between(text)
        out = []
        for p in self.parts.split(text):
            out += [self.special[p]] if p in self.special else self._between(p)
        return out

    def _between(self, text: str) -> list[int]:
        if len(text) <= self.leaf or max(map(len, text.split(" "))) < self.leaf and " " * self.leaf not in text:
            return self.merge(text)
        # There may be long stretches that the pre-tokenizer leaves whole: those by halves.
        out: list[int] = []
        for p in self.pre.findall(text):
            if len(p) <= self.leaf:
                out += self.merge(p)
            else:
                out += self.by_halves(p)
        return out

    def by_halves(self, text: str) -> list[int]:
        """The ids of one pre-token: leaves in parallel, then joined pairwise up the tree."""
        leaves = [text[i : i + self.leaf] for i in range(0, len(text), self.leaf)]
        level = [self.merge(x) for x in leaves]
        while len(level) > 1:
            level = [self.joined(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0] if level else []

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of two neighbours within a pre-token. The window around the join grows until its first ids are those
        of the left side and its last those of the right side; neighbours that merge nowhere then stand at its ends."""
        k = 8
        while True:
            a, b = left[-k:], right[:k]
            try:
                text = b"".join(self.bytes[i] for i in [*a, *b]).decode()
            except UnicodeDecodeError:
                text = None
            whole_left, whole_right = k >= len(left), k >= len(right)
            if text is not None:
                w = self.merge(text)
                if (whole_left or w[:2] == a[:2]) and (whole_right or w[-2:] == b[-2:]):
                    return left[: len(left) - len(a)] + w + right[len(b) :]
            if whole_left and whole_right:
                raise ValueError("the sides of a join aren't text")
            k = k + 1 if text is None else 2 * k

    def known_cut(self, text: str, at: int) -> bool:
        """Whether encoding may start or end at a place of the text, as far as the characters around it tell: either a
        pre-token ends there in any surroundings, or the place is inside of one that goes on in any surroundings."""
        reach = self.longest_special
        if at < 3 or at + 2 > len(text) or any(x in text[max(0, at - reach) : at + reach] for x in self.special):
            return False
        before, after = _kind(text[at - 1]), _kind(text[at])
        if "?" in (before, after):
            return False
        if before != after:
            # A space may belong to what follows it, and an apostrophe to a contraction.
            return before != " " and text[at - 1] != "'" and text[at] in " \n\t" or " " not in (before, after) and "'" not in (text[at - 1], text[at])
        if before == "L":  # two more letters, else a contraction may end here
            return _kind(text[at - 2]) == _kind(text[at - 3]) == "L"
        if before == " ":  # the last space of several may stand apart
            return _kind(text[at + 1]) == " "
        return text[at] != "'"

    def _edge(self, text: str, ids: np.ndarray, k: int, left: bool) -> tuple[int, int]:
        """``(n, at)``: the least n of at least ``k`` ids next to the join, after the left side's or before the right
        side's place ``at``, where encoding may start or end; all ids if there is no such place."""
        near = ids[::-1] if left else ids
        n = size = 0
        while True:
            # One id more at a time; where that leads nowhere for long, a quarter more.
            step = near[n : n + (k if n < k else 1 if n < k + 64 else n // 4)]
            n, size = n + len(step), size + int(self.lengths[step].sum())
            if n == len(ids):
                return n, 0 if left else len(text)
            raw = (text[-size:] if left else text[: size + 1]).encode()
            at = len(raw) - size if left else size
            if raw[at] & 0xC0 == 0x80:  # inside a character
                continue
            chars = len((raw[at:] if left else raw[:at]).decode())
            at = len(text) - chars if left else chars
            if chars >= 2 * self.longest_special and self.known_cut(text, at):
                return n, at

    def join_texts(self, left: tuple[str, bytes], right: tuple[str, bytes]) -> tuple[str, bytes]:
        """Two neighbouring stretches of a document, cut anywhere, each (text, ids). Only a window around the join is
        encoded again; it starts and ends at ids of the two sides, and grows until its first ids are those of the left
        side and its last those of the right side: what lies beyond is then encoded as it would be in the whole.
        ``recoded`` counts the characters of all windows."""
        (ta, ra), (tb, rb) = left, right
        ia, ib = np.frombuffer(ra, "<u4"), np.frombuffer(rb, "<u4")
        k_a = k_b = WINDOW
        while True:
            n_a, start = self._edge(ta, ia, k_a, True)
            n_b, end = self._edge(tb, ib, k_b, False)
            text = ta[start:] + tb[:end]
            self.recoded += len(text)
            w = self.ids(text)
            ok_a = n_a == len(ia) or w[:2] == ia[len(ia) - n_a :][:2].tolist()
            ok_b = n_b == len(ib) or w[-2:] == ib[:n_b][-2:].tolist()
            if ok_a and ok_b:
                return ta + tb, ra[: 4 * (len(ia) - n_a)] + array("I", w).tobytes() + rb[4 * n_b :]
            k_a, k_b = k_a if ok_a else 2 * n_a, k_b if ok_b else 2 * n_b


@functools.lru_cache(maxsize=1 << 16)
def _kind(c: str) -> str:
    """The class that the pre-tokenizer puts a character in: letter, number, space or other; ? where engines differ."""
    kind = unicodedata.category(c)
    if c in "\x1c\x1d\x1e\x1f\x85\u180e" or kind == "Cn":
        return "?"
    return " " if c.isspace() else kind[0] if kind[0] in "LN" else "."


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, leaf: int = DOCUMENT_LEAF) -> DataFrame:
    """``id_col, ids``: each whole text's ids as little-endian unsigned 32-bit integers.

    Texts of up to ``leaf`` characters are encoded where they are read, without a shuffle. Longer ones are cut into
    leaves of ``leaf`` characters, which tasks encode in parallel, and joined per distinct text, so copies cost a key
    each; a task holds one text and its ids at a time.
    """
    text_batches(docs.sparkSession)
    path = path or vocabulary_path()
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    short = rows.where(F.length("text") <= leaf).mapInArrow(tidied(_encode_rows(path)), f"id {kind}, ids binary")
    rows = rows.where(F.length("text") > leaf).withColumn("key", F.sha2("text", 256))
    cuts = F.sequence(F.lit(0), ((F.length("text") - 1) / leaf).cast("int"))
    leaves = rows.select("key", "text", F.explode(cuts).alias("pos")).select("key", "pos", F.expr(f"substring(text, pos * {leaf} + 1, {leaf})").alias("text"))
    # Copies of a text are one from here on; the exchange of this step deals the leaves out, too.
    leaves = leaves.dropDuplicates(["key", "pos"]).mapInArrow(tidied(_encode_rows(path)), "key string, pos int, text string, ids binary")
    whole = leaves.groupBy("key").applyInPandas(_join_rows(path), "key string, ids binary")
    long = rows.select("id", "key").join(whole, "key").select("id", "ids")
    return short.unionByName(long).withColumnRenamed("id", id_col)


def _encode_rows(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            ids = enc.encode_many(b.column("text").to_pylist())
            names = [n for n in b.schema.names if n != "text" or "pos" in b.schema.names]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(ids, pa.binary())], [*names, "ids"])

    return run


def _join_rows(path: str):
    def run(rows):
        enc = encoder(path)
        rows = rows.sort_values("pos")
        level = list(zip(rows["text"], map(bytes, rows["ids"]), strict=True))
        while len(level) > 1:
            level = [enc.join_texts(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return rows.iloc[:1][["key"]].assign(ids=[level[0][1]])

    return run


def decode(encoded: DataFrame, ids_col: str = "ids", out_col: str = "decoded", path: str | None = None) -> DataFrame:
    """``encoded`` with the text of its ids in ``out_col``, special tokens included; bytes that aren't UTF-8 become
    U+FFFD. Null ids count as none; an id outside the vocabulary stands for no bytes."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for b in batches:
            texts = []
            for x in b.column(ids_col).to_pylist():
                ids = array("I", x or b"")
                try:
                    raw = b"".join(map(table.__getitem__, ids))
                except IndexError:
                    raw = b"".join(table[i] for i in ids if i < len(table))
                texts.append(raw.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, out_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != out_col)
    return encoded.select(*[c for c in encoded.columns if c != out_col]).mapInArrow(tidied(run), f"{schema}, `{out_col}` string")
