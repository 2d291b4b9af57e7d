"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

Encoding maps each UTF-8 byte to a printable character (the byte table), lets the library
split and merge, and maps tokens back to byte and character offsets. Decoding reverses the
byte table; a character that is split over tokens belongs to the token that completes it.

Nulls: a null text counts as empty; a null id is carried. Empty texts have no tokens.
Repeated rows are encoded one by one. Extra columns are ignored by ``digests`` and kept by
``encode``. Whole texts are processed, of any length. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import codecs
import functools
import hashlib
from collections.abc import Iterable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from vigilake.llm.common import small_batches, table

#: Words that a worker remembers before it begins anew.
MEMO_WORDS = 500_000
#: Unseen words of one text for the library, which is slower on long texts.
WORDS_AT_ONCE = 500
#: ASCII marks that are no part of a contraction.
MARKS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'


@functools.cache
def byte_table() -> tuple[str, ...]:
    """Byte -> character: visible Latin-1 stands for itself, the rest moves up from 256 in order."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = [""] * 256
    for b in visible:
        out[b] = chr(b)
    for k, b in enumerate(x for x in range(256) if x not in set(visible)):
        out[b] = chr(256 + k)
    return tuple(out)


_KEEP = {b: c for b, c in enumerate(byte_table()) if b not in (10, 32)}


def load_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank, from a file with one base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _parts(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts whose merge makes ``token``: merge lower ranks until two are left."""
    parts, limit = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        best = min(
            range(len(parts) - 1),
            key=lambda i: (r if (r := ranks.get(parts[i] + parts[i + 1], limit)) < limit else limit, i),
        )
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts[0], parts[1]


@functools.cache
def tokenizer_json(path: str, pattern: str) -> str:
    """A tokenizers definition (about 3 MB, as many entries as ranks) that follows the rank file."""
    ranks, char = load_ranks(path), byte_table()
    word = lambda token: "".join(char[b] for b in token)
    merges = [tuple(map(word, _parts(t, ranks))) for t in sorted(ranks, key=ranks.get) if len(t) > 1]
    t = Tokenizer(models.BPE({word(k): v for k, v in ranks.items()}, merges, ignore_merges=True))
    t.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(False, use_regex=False)]
    )
    return t.to_str()


def token_bytes(definition: str) -> list[bytes]:
    """id -> bytes, by reversing the byte table; added tokens stand for their UTF-8."""
    t, back = Tokenizer.from_str(definition), {c: b for b, c in enumerate(byte_table())}
    out = [b""] * (max(t.get_vocab().values()) + 1)
    for word, i in t.get_vocab().items():
        out[i] = bytes(back[c] for c in word) if all(c in back for c in word) else word.encode()
    return out


@functools.cache
def encoder_of(definition: str) -> Encoder:
    """The worker process's encoder: what it remembers serves its later tasks too."""
    return Encoder(definition)


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places start[i], start[i] + 1, ... of each of ``size[i]`` neighbours, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


class Memo:
    """Ids of words: the words' slots, and each slot's place in one array."""

    def __init__(self):
        self.slot: dict[str, int] = {}
        self.tails: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)

    def add(self, words: list[str], ids: np.ndarray, length: np.ndarray) -> None:
        first = len(self.start)
        self.slot.update(zip(words, range(first, first + len(words))))
        self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(length) - length))
        self.length = np.concatenate((self.length, length))
        self.ids = np.concatenate((self.ids, ids))


class Encoder:
    """Encodes whole texts; one per worker process.

    The pre-tokenizer always breaks before a space that is followed by a visible character,
    so the pieces of ``text.split(" ")`` can be encoded apart and remembered. Texts with
    other uses of spaces, or with the string of an added token, go to the library as a whole.
    Words not seen lately are encoded as short texts of some words, which are cut at the words again.
    Where the pre-tokenizer takes a line feed before visible characters, a run of letters with the space
    before it, and a run of marks as pieces (``lines``), texts are cut at line feeds too, words of letters
    go to the library's merges as they are, and marks behind such a word are encoded apart.
    """

    def __init__(self, definition: str):
        self.tokenizer = Tokenizer.from_str(definition)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = Tokenizer.from_str(definition)
        self.letters.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        pieces = [x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str("\nAb. cd\nef*")]
        self.lines = pieces == ["Ċ", "Ab", ".", "Ġcd", "Ċ", "ef", "*"]
        self.size = np.array([len(b) for b in token_bytes(definition)])
        self.memo = Memo()

    def _whole(self, texts: list[str], library: Tokenizer | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        ids = [e.ids for e in (library or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]
        length = np.array([len(i) for i in ids], np.int64)
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(length.sum())), length

    def _learn(self, words: list[str]) -> None:
        """Remember the ids of each word with a space before it, or, if it starts a line, with that line feed; -1: can't be encoded apart."""
        memo, letters, other = self.memo, {}, []
        marked, stems, tails = [], [], []
        for w in words:
            if w.isalpha():
                letters[w] = None
                continue
            stem = w.rstrip(MARKS)
            if self.lines and stem[1:].isalpha() and (stem[0] == "\n" or stem[0].isalpha()):
                if len(stem) == len(w):
                    letters[w] = None
                else:
                    marked.append(w)
                    stems.append(stem)
                    tails.append(w[len(stem) :])
                    if stem not in memo.slot:
                        letters[stem] = None
            elif w and not w[0].isspace() or w[0:1] == "\n" and self.lines and w[1:2].strip():
                other.append(w)
            else:
                memo.slot[w] = -1
        for new, library in ((list(letters), self.letters), (other, self.tokenizer)):
            if new:
                at_line = np.fromiter((w[0] == "\n" for w in new), bool, len(new))
                lots = [" ".join(new[k : k + WORDS_AT_ONCE]).replace(" \n", "\n") for k in range(0, len(new), WORDS_AT_ONCE)]
                lots = [x if x[0] == "\n" else " " + x for x in lots]
                if library is self.letters:  # as the pre-tokenizer would leave it, but for spaces between pieces
                    lots = [(x if x.isascii() else x.encode().decode("latin-1").translate(_KEEP)).replace(" ", " Ġ").replace("\n", " Ċ ").lstrip(" ") for x in lots]
                ids, _ = self._whole(lots, library)
                ends = np.cumsum(pc.binary_length(pa.array(new, pa.large_string())).to_numpy() + ~at_line)
                memo.add(new, ids, np.diff(np.searchsorted(np.cumsum(self.size[ids]), ends) + 1, prepend=0))
        if marked:
            for tail in set(tails) - memo.tails.keys():
                ids, length = self._whole([tail])
                memo.tails[tail] = len(memo.start)
                memo.add([], ids, length)
            parts = np.empty((len(marked), 2), np.int64)
            parts[:, 0] = np.fromiter(map(memo.slot.__getitem__, stems), np.int64, len(stems))
            parts[:, 1] = np.fromiter(map(memo.tails.__getitem__, tails), np.int64, len(tails))
            length = memo.length[parts]
            memo.add(marked, memo.ids[ragged(memo.start[parts.ravel()], length.ravel())], length.sum(axis=1))

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and how many each text has."""
        if len(self.memo.slot) > MEMO_WORDS:
            self.memo = Memo()
        n = len(texts)
        given = pa.array([t or "" for t in texts], pa.large_string())
        split = pc.split_pattern(pc.replace_substring(given, "\n", " \n") if self.lines else given, " ")
        at = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        words, code = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        slot = np.fromiter(map(self.memo.slot.get, words, repeat(-2)), np.int64, len(words))
        if len(new := np.flatnonzero(slot == -2)):
            unseen = [words[k] for k in new.tolist()]
            self._learn(unseen)
            slot[new] = np.fromiter(map(self.memo.slot.__getitem__, unseen), np.int64, len(unseen))
        slot = slot[code]
        tail = np.ones(len(code), bool)
        tail[at[:-1]] = False
        whole = np.zeros(n, bool)
        text_of = np.repeat(np.arange(n), np.diff(at))
        whole[text_of[tail & (slot < 0)]] = True
        for a in self.added:
            whole |= np.array([a in t if t else False for t in texts], bool)
        # the head of a text, or all of it, as one more word behind those remembered
        heads, head_length = self._whole([t or "" if all_ else words[code[k]] for t, all_, k in zip(texts, whole.tolist(), at[:-1].tolist(), strict=True)])
        start = np.concatenate((self.memo.start, len(self.memo.ids) + np.cumsum(head_length) - head_length))
        length = np.concatenate((self.memo.length, head_length))
        used = slot
        used[at[:-1]] = len(self.memo.start) + np.arange(n)
        kept = ~(whole[text_of] & tail)
        used, text_of = used[kept], text_of[kept]
        size = length[used]
        ids = np.concatenate((self.memo.ids, heads))[ragged(start[used], size)]
        return ids, np.bincount(text_of, size, minlength=n).astype(np.int64)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids, n = self.encode_flat(texts)
        raw, ends = ids.tobytes(), np.cumsum(n).tolist()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *ends], ends)]  # noqa: B905


def in_small_lots(texts: list[str | None], lot: int = 1_000_000) -> Iterable[list[str | None]]:
    """Lots of at most about ``lot`` characters, so that a batch of long texts needs little memory."""
    out: list[str | None] = []
    n = 0
    for t in texts:
        out.append(t)
        n += len(t or "")
        if n >= lot:
            yield out
            out, n = [], 0
    if out:
        yield out


def over_batches(batches: Iterable[pa.RecordBatch], key: str = "doc_id", lot: int = 4_000_000) -> Iterable[tuple[list, list[str | None]]]:
    """(keys, texts) in lots of about ``lot`` characters across batches: the larger a lot, the more often a word comes again in it."""
    keys, texts, n = [], [], 0
    for b in batches:
        for k, t in zip(b.column(b.schema.names.index(key)).to_pylist(), b.column(b.schema.names.index("text")).to_pylist(), strict=True):
            keys.append(k)
            texts.append(t)
            n += len(t or "")
            if n >= lot:
                yield keys, texts
                keys, texts, n = [], [], 0
    if keys:
        yield keys, texts


def spans(ids: np.ndarray, size: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Character offsets [start, end) of each token: byte offsets through the map from bytes to characters.

    A token that holds a part of a character covers the whole character.
    """
    ends = np.cumsum(size[ids])
    raw = np.frombuffer(text.encode(), np.uint8)
    chars = np.cumsum((raw & 0xC0) != 0x80)  # number of the character that each byte belongs to, from 1
    start, last = ends - size[ids], ends - 1
    return chars[start] - 1 if len(ids) else start, chars[last] if len(ids) else ends


def decode_parts(ids: Iterable[int], table: list[bytes]) -> list[str]:
    """Text that each token adds. Bytes of a split character wait for the token that completes it."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    parts = [decoder.decode(table[i]) for i in ids]
    if parts:
        parts[-1] += decoder.decode(b"", True)
    return parts


def encode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with bpe_ids, bpe_start and bpe_end (character offsets, end exclusive)."""
    definition = df.sparkSession.sparkContext.broadcast(tokenizer_json(path, pattern))
    names = ("bpe_ids", "bpe_start", "bpe_end")
    kept = df.drop(*names)
    schema = StructType([*kept.schema.fields, *(StructField(n, ArrayType(IntegerType())) for n in names)])

    def run(batches):
        encoder = encoder_of(definition.value)
        size = encoder.size
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text)).to_pylist()
            ids = [np.frombuffer(x, np.uint32) for lot in in_small_lots(texts) for x in encoder.encode(lot)]
            at = [spans(i, size, t or "") for i, t in zip(ids, texts, strict=True)]
            new = [pa.array([x.tolist() for x in col], pa.list_(pa.int32())) for col in (ids, [a for a, _ in at], [b for _, b in at])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    return kept.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "bpe_ids") -> DataFrame:
    """``df`` with bpe_text: the decoded text, broken characters replaced by U+FFFD; null ids: empty."""
    definition = df.sparkSession.sparkContext.broadcast(tokenizer_json(path, pattern))
    kept = df.drop("bpe_text")
    schema = StructType([*kept.schema.fields, StructField("bpe_text", StringType())])

    def run(batches):
        back = token_bytes(definition.value)
        for batch in batches:
            rows = batch.column(batch.schema.names.index(ids)).to_pylist()
            texts = ["".join(decode_parts(x or [], back)) for x in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "bpe_text"])

    return kept.mapInArrow(run, schema)


def digests(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256; ids and bytes stay in the task."""
    definition = df.sparkSession.sparkContext.broadcast(tokenizer_json(path, pattern))

    schema = df.sparkSession.createDataFrame([], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string").schema

    def run(batches):
        encoder, back = encoder_of(definition.value), token_bytes(definition.value)
        decimal = [str(i) for i in range(len(back))]
        for keys, texts in over_batches(batches):
            flat, n = encoder.encode_flat(texts)
            flat, ids_sha, decoded_sha, at = flat.tolist(), [], [], 0
            for end in np.cumsum(n).tolist():
                ids, at = flat[at:end], end
                ids_sha.append(hashlib.sha256(" ".join([decimal[i] for i in ids]).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(b"".join([back[i] for i in ids])).hexdigest())
            columns = [pa.array(keys, pa.int64()), pa.array(n), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    small_batches(df.sparkSession)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6 over all documents."""
    import public_tokenizers

    return digests(
        table(spark, sf_dir, "documents", "doc_id", "text"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )
