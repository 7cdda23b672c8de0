"""Byte-level BPE by prefix-sharing trie traversal.

Distinct words (pieces of the pre-tokeniser) are put in byte order, so that walking them visits a
trie depth first. Each node on the way keeps the last token of the encoding of its prefix and where that token
starts; a word's ids are read back from its end by way of those starts, so memory is in proportion to the longest word. One rule extends a node by a byte: of the vocabulary's tokens that end
the new prefix, exactly one may follow the last token of the prefix before it; two tokens may be
neighbours if BPE, run over their joined bytes, leaves them apart. What words share is encoded once.

Nulls count as the empty text; an empty text has no tokens, the hash of nothing and decodes to
nothing. Repeated rows each get their row. Texts and pieces have no length limit. Columns other than the id, the text and those
that `keep` names are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from sparkmill.llm.common import held, slices, texts_of

# The pattern by which the byte-level pre-tokeniser cuts a text into pieces.
PIECE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pieces, and pairs of neighbouring tokens, that a worker remembers from one slice of its rows to the next.
REMEMBERED, PAIRS = 150_000, 200_000
#: Longer pieces are encoded each time they occur.
REMEMBERED_CHARS = 64


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable bytes stand for themselves, the rest follow from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    letters = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    letters |= {chr(256 + k): b for k, b in enumerate(rest)}
    return letters


class PrefixBpe:
    """Encoder and decoder for one vocabulary file of the tokenizers library."""

    def __init__(self, raw: bytes, remembered: tuple[int, int] | None = None):
        self.remembered = remembered
        spec = json.loads(raw)
        letters = byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        token_bytes: dict[int, bytes] = {i: as_bytes(t) for t, i in vocab.items() if t not in self.special}
        token_bytes |= {i: t.encode() for t, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = regex.compile(PIECE_PATTERN).findall
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b, both = vocab[left], vocab[right], vocab[left + right]
            self.rank[a, b] = rank
            self.halves.setdefault(both, (a, b, rank))
        self.made = {t: i for i, t in token_bytes.items() if (i in self.halves or len(t) == 1) and i not in self.special.values()}
        if missing := [b for b in range(256) if bytes([b]) not in self.made]:
            raise ValueError(f"the vocabulary has no token for {len(missing)} of the bytes")
        self.neighbours: dict[int, bool] = {}
        self.edges: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self.ids: dict[str, str] = {}
        self.written = {str(i): b for i, b in token_bytes.items()}

    @property
    def bounds(self) -> tuple[int, int]:
        return self.remembered or (REMEMBERED, PAIRS)

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The symbols at the token's right (1) or left (0) end, innermost first, each with the rank that absorbs it."""
        if (token, side) not in self.edges:
            if len(self.edges) > self.bounds[0] // 4:
                self.edges.clear()
            chain, absorbed = [(token, float("inf"))], token
            while absorbed in self.halves:
                rank = self.halves[absorbed][2]
                absorbed = self.halves[absorbed][side]
                chain.append((absorbed, rank))
            self.edges[token, side] = chain[::-1]
        return self.edges[token, side]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether BPE over the two tokens' bytes never merges across their border."""
        ends, starts = self.edge(left, 1), self.edge(right, 0)
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = ends[i], starts[j]
            across = self.rank.get((x, y), float("inf"))
            if across < x_until and across <= y_until:
                return False
            if x_until == y_until == float("inf"):
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def encode_sorted(self, words: list[bytes]) -> Iterator[str]:
        """Ids, joined by commas, of each of the distinct words, which come in byte order."""
        token_at, neighbours, most_pairs = self.made.get, self.neighbours, self.bounds[1]
        last, starts, before = [-1], [0], b""
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], starts[shared + 1 :]
            for at in range(shared + 1, len(word) + 1):
                start = at - 1
                while True:  # a byte by itself is a token, so some token ends here
                    if (token := token_at(word[start:at])) is not None:
                        if not start:
                            break
                        key = last[start] << 20 | token
                        if (fits := neighbours.get(key)) is None:
                            if len(neighbours) > most_pairs:
                                neighbours.clear()
                            fits = neighbours[key] = self.may_follow(last[start], token)
                        if fits:
                            break
                    start -= 1
                last.append(token)
                starts.append(start)
            ids, at = [], len(word)
            while at:
                ids.append(last[at])
                at = starts[at]
            ids.reverse()
            yield ",".join(map(str, ids))
            before = word

    def learn(self, pieces: set[str]) -> None:
        new = sorted([(p.encode(), p) for p in pieces])
        for (_, piece), ids in zip(new, self.encode_sorted([b for b, _ in new]), strict=True):
            self.ids[piece] = ids

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.written.__getitem__, ids.split(","))) if ids else b""

    def forget(self, pieces: set[str]) -> None:
        """Drop what goes beyond the bound: the pieces met first, most of them frequent, stay."""
        room = len(self.ids) - self.bounds[0]
        for p in pieces:
            if room > 0 or len(p) > REMEMBERED_CHARS:
                del self.ids[p]
                room -= 1

    def encode(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """For each text its ids, joined by commas, and the bytes that they decode to."""
        split: list[list[list[str] | int]] = []
        wanted: set[str] = set()
        for t in texts:
            parts = [s for s in self.cut.split(t) if s] if self.cut and any(s in t for s in self.special) else [t] if t else []
            split.append([self.special[s] if s in self.special else self.pieces(s) for s in parts])
            for part in split[-1]:
                if not isinstance(part, int):
                    wanted.update(part)
        new = wanted.difference(self.ids)
        self.learn(new)
        ids_of, out = self.ids.__getitem__, []
        for parts in split:
            ids = ",".join([str(x) if isinstance(x, int) else ",".join(map(ids_of, x)) for x in parts])
            out.append((ids, self.decode(ids)))
        self.forget(new)
        return out


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_text: bool = False, remembered: tuple[int, int] | None = None) -> DataFrame:
    """Encode each whole text and decode it again.

    Returns id_col, keep's columns, n_tokens, ids_sha256 and decoded_sha256, and with_text also
    token_ids array<int> and decoded string. The vocabulary file (a few MB, fixed) is broadcast. remembered: pieces and pairs that a worker keeps.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    kept = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = held(("bpe", xxhash.xxh3_64_intdigest(vocabulary.value), remembered), lambda: PrefixBpe(vocabulary.value, remembered))
        for batch in slices(batches, len(kept), 256, 500_000):
            coded = bpe.encode(texts_of(batch.column(len(kept))))
            decoded = [d.decode("utf-8", "replace") for _, d in coded]
            columns = [batch.column(k) for k in range(len(kept))]
            columns += [
                pa.array([ids.count(",") + 1 if ids else 0 for ids, _ in coded], pa.int64()),
                pa.array([hashlib.sha256(ids.encode()).hexdigest() for ids, _ in coded], pa.string()),
                pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()),
            ]
            names = [*kept, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_text:
                columns += [pa.array([[int(i) for i in ids.split(",")] if ids else [] for ids, _ in coded], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names += ["token_ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept]
    fields += ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"] + ["token_ids array<int>", "decoded string"] * with_text
    return docs.select(*kept, text_col).mapInArrow(run, ", ".join(fields))
