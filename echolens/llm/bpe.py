"""Byte-level BPE encoding as a bounded-lookahead streaming transducer, and incremental decoding.

Encoding. ``lookahead(merges)`` computes how many trailing bytes of a prefix can still be tokenised
otherwise when more input comes. Take the segmentations of a prefix and of its continuation after the
rules of rank 0..r: they agree up to some common boundary. Rule r+1 = (u, v) moves that boundary
left only by joining u, the last agreed token, with a token v that starts behind it; v then starts
with what was lost before. So the loss is bounded by chains of rules i1 < i2 < ... in which each v
starts with the previous u, and the longest sum of |u| over such a chain suffices. A token that
ends at least that far from the end of the buffer is stable: it is emitted, and since a boundary
splits the merging into independent halves, the transducer goes on from there with the rest. The
buffer never exceeds ``WINDOW + lookahead`` bytes, whatever the length of a word.

Decoding. Token bytes go through an incremental UTF-8 state machine, so a character split over
tokens, or over blocks of tokens, comes out whole; invalid sequences become U+FFFD.

Rows: one per input row, repeated rows repeated. A null text is an empty one: no tokens.
"""

import codecs
import hashlib
import json
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolens.llm.tables import TwoAgeCache, batch_of, in_batches

# The pre-tokenisation pattern that byte-level vocabularies of this family define; a fixed value. Letters
# come first, which changes no match and saves attempts.
PATTERN = (r" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
           r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
BLOCK = 1 << 16        # characters whose words are looked up at once
WINDOW = 512           # bytes of one word merged at once, besides the lookahead
CACHED_LENGTH = 64
CACHE_ENTRIES = 600_000
TOKEN_BITS = 24        # a rule is kept as rank and resulting token in one integer, so that it sorts by rank
TOKEN = (1 << TOKEN_BITS) - 1
NO_RULE = 1 << 62


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes behind a token's end after which no continuation can change it."""
    lost: dict[bytes, int] = {}  # by u: the longest chain that ends with a rule (u, .)
    for u, v in merges:
        total = len(u) + max((lost.get(v[:k], 0) for k in range(1, len(v) + 1)), default=0)
        lost[u] = max(lost.get(u, 0), total)
    return max(lost.values(), default=0)


class ByteBpe:
    def __init__(self, vocabulary_file: str):
        with open(vocabulary_file, encoding="utf-8") as f:
            stored = json.load(f)
        letters = byte_letters()
        plain = lambda token: bytes(letters[c] for c in token)
        vocabulary = {plain(t): i for t, i in stored["model"]["vocab"].items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in stored["model"]["merges"]]
        merges = [(plain(a), plain(b)) for a, b in pairs]
        self.rule = {(vocabulary[a], vocabulary[b]): r << TOKEN_BITS | vocabulary[a + b]
                     for r, (a, b) in reversed(list(enumerate(merges)))}
        self.of_byte = [vocabulary[bytes([b])] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        self.is_special = frozenset(self.special.values())
        self.bytes_of = ({i: b for b, i in vocabulary.items()}
                         | {i: s.encode("utf-8") for s, i in self.special.items()})
        self.decimal = {i: str(i) for i in self.bytes_of}
        self.one = {i: i for i in self.bytes_of}  # the one object of each id, for the cache to hold
        self.lookahead = lookahead(merges)
        self.pattern = regex.compile(PATTERN)
        self.marks = (regex.compile("|".join(map(regex.escape, sorted(
            self.special, key=len, reverse=True)))) if self.special else None)
        self.cache = TwoAgeCache(self._word, CACHE_ENTRIES)

    def merge(self, data: bytes) -> list[int]:
        """Tokens of a bounded buffer: the lowest-ranked pair, leftmost first, is joined until none is left."""
        rule = self.rule.get
        ids = [self.of_byte[b] for b in data]
        best = [rule(pair, NO_RULE) for pair in zip(ids, ids[1:])]
        while best:
            found = min(best)
            if found == NO_RULE:
                break
            i = best.index(found)
            ids[i:i + 2] = [found & TOKEN]
            del best[i]
            if i:
                best[i - 1] = rule((ids[i - 1], ids[i]), NO_RULE)
            if i < len(best):
                best[i] = rule((ids[i], ids[i + 1]), NO_RULE)
        return ids

    def transduce(self, chunks):
        """Token lists of one word that comes in byte chunks, each emitted as soon as it is stable."""
        held = b""
        for chunk in chunks:
            held += chunk
            while len(held) >= WINDOW + self.lookahead:
                part = held[:WINDOW + self.lookahead]
                stable, end, limit = [], 0, len(part) - self.lookahead
                for token in self.merge(part):
                    size = len(self.bytes_of[token])
                    if end + size > limit:
                        break
                    stable.append(token)
                    end += size
                if not end:  # WINDOW is longer than any token, so this can't happen with sane vocabularies
                    raise ValueError("a token is longer than the window")
                yield stable
                held = held[end:]
        if held:
            yield self.merge(held)

    def _word(self, word: str) -> tuple[int, ...]:
        return tuple(map(self.one.__getitem__, self.merge(word.encode("utf-8"))))

    def _long_word(self, text: str, start: int, end: int):
        return self.transduce(text[i:min(i + WINDOW, end)].encode("utf-8")
                              for i in range(start, end, WINDOW))

    def _plain(self, text: str, start: int, end: int):
        """Token lists of a stretch without special strings."""
        get = self.cache.__getitem__
        while start < end:
            stop = min(start + BLOCK, end)
            words = self.pattern.findall(text, start, stop)
            if stop < end:
                # what touches the end of the block may go on behind it, and an apostrophe before it begin 're, 've or 'll
                stop -= len(words.pop())
                if words and words[-1] == "'":
                    stop -= len(words.pop())
                if not words:
                    stop = self.pattern.match(text, start, end).end()
                    yield from self._long_word(text, start, stop)
            if words:
                if max(map(len, words)) <= CACHED_LENGTH:
                    yield list(chain.from_iterable(map(get, words)))
                else:
                    for w in words:
                        if len(w) <= CACHED_LENGTH:
                            yield get(w)
                        else:
                            yield from self._long_word(w, 0, len(w))
            start = stop

    def encode(self, text: str):
        """Yield lists of token ids, in order; special strings in the text become their own ids."""
        start = 0
        for m in self.marks.finditer(text) if self.marks else ():
            yield from self._plain(text, start, m.start())
            yield [self.special[m[0]]]
            start = m.end()
        yield from self._plain(text, start, len(text))

    def decode(self, blocks):
        """Yield the text of token-id blocks; state between blocks is at most three bytes."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        get = self.bytes_of.__getitem__
        for ids in blocks:
            yield machine.decode(b"".join(map(get, ids)))
        yield machine.decode(b"", True)

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, SHA-256 of the decimal ids, SHA-256 of the decoded text, in one stream."""
        ids_hash, text_hash, n = hashlib.sha256(), hashlib.sha256(), 0
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        raw, decimal = self.bytes_of.__getitem__, self.decimal.__getitem__
        for ids in self.encode(text):
            if ids:
                ids_hash.update(("," * (n > 0) + ",".join(map(decimal, ids))).encode())
                text_hash.update(machine.decode(b"".join(map(raw, ids))).encode("utf-8"))
                n += len(ids)
        text_hash.update(machine.decode(b"", True).encode("utf-8"))
        return n, ids_hash.hexdigest(), text_hash.hexdigest()


_CODERS: dict[str, ByteBpe] = {}


def coder(vocabulary_file: str) -> ByteBpe:
    if vocabulary_file not in _CODERS:
        _CODERS[vocabulary_file] = ByteBpe(vocabulary_file)
    return _CODERS[vocabulary_file]


def encode(df: DataFrame, vocabulary_file: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>)``: the token ids of every whole text."""
    out = pa.schema([(id_col, pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        bpe = coder(vocabulary_file)
        for batch in batches:
            yield batch_of(out, [batch.column(0), [
                list(chain.from_iterable(bpe.encode(t))) if t else []
                for t in batch.column(1).to_pylist()]])

    return in_batches(df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")),
                      run, f"`{id_col}` long, ids array<int>")


def decode(df: DataFrame, vocabulary_file: str, id_col: str = "doc_id",
           ids_col: str = "ids") -> DataFrame:
    """``(id, text)`` of every row of token ids; a null list gives the empty text, an unknown id an error."""
    out = pa.schema([(id_col, pa.int64()), ("text", pa.string())])

    def run(batches):
        bpe = coder(vocabulary_file)
        for batch in batches:
            yield batch_of(out, [batch.column(0), [
                "".join(bpe.decode([ids or []])) for ids in batch.column(1).to_pylist()]])

    return in_batches(df.select(F.col(id_col).cast("long"), F.col(ids_col)),
                      run, f"`{id_col}` long, text string")


def round_trip(df: DataFrame, vocabulary_file: str, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: encodes and decodes every text block by block,
    without holding its tokens; map-only."""
    out = pa.schema([(id_col, pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                     ("decoded_sha256", pa.string())])

    def run(batches):
        bpe = coder(vocabulary_file)
        for batch in batches:
            done = [bpe.digest(t or "") for t in batch.column(1).to_pylist()]
            yield batch_of(out, [batch.column(0), *([d[k] for d in done] for k in range(3))])

    return in_batches(df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")),
                      run, f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")
