"""Lexical retrieval packing: windows filled with what a sharded BM25 index returns.

A partition's documents pass through in shards of at most SHARD_ROWS documents
and about SHARD_TOKENS tokens. Each shard has an inverted index with BM25
weights over token ids. A seed document opens a window of WINDOW tokens; the
unused documents nearest to it by all its terms fill the window, the last of
them is cut, and what is left of it opens the next window as its seed. Where the
index returns nothing unused, the next document in order comes. An open window
is carried into the next shard, and only the end of a partition leaves one: its
tokens go to sequences of falling powers of two, which need no padding.

It is one narrow pass: texts are tokenized and packed where they are read, with
no shuffle and no state beyond a shard. Token ids are looked up by word, as the
tokenizer never merges across white space; words not seen lately are encoded.

Defined cases: a null or empty text is the end id alone; repeated rows are
packed each; a text longer than a window spans several; an empty table gives an
empty result; other columns are ignored. sequence_id is unique in the result,
and the same whenever the same partition is computed again.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import release_memory, small_batches

WINDOW, END_ID = 2048, 1
SHARD_ROWS, SHARD_BYTES = 1024, 6_000_000
K1, B = 1.2, 0.75
#: Words remembered by a worker, some 50 bytes each; beyond, only those that came up again.
REMEMBERED = 300_000
LATIN = "^[\\x{00}-\\x{ff}]*$"
#: Terms that a document of so many has get a dense row in the index.
DENSE_SHARE = 16


class WordIds:
    """Token ids of whole texts, looked up by word; little-endian 16-bit numbers (32-bit for larger vocabularies).

    The tokenizer never merges across white space, nor across the border of letters and
    punctuation, and it ignores case; so the ids of a word that ends in punctuation are
    those of its letters and of the marks. New words of letters only are encoded many at a time: each
    of them ends with the one token that has the word-end suffix. The string of a special token is that
    token's id wherever it stands in a text, as the tokenizer has it.

    All ids of known words stand in one array; a batch of texts is split and its words numbered by
    Arrow, and the ids of all its texts are one gather from that array.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.full = (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)
        # For runs of lower-case Latin-1 letters the normalizer and the splitting pattern change nothing.
        self.short = (normalizers.Sequence([]), pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]))
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        # The strings of special tokens are found before a text is split, in any word; each is one id.
        self.special = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.clear()
        self._check()

    def _check(self) -> None:
        """The short ways must give what the tokenizer gives for a text as a whole; a vocabulary for which they don't is refused."""
        for text in ("The Quick brown fox, (jumped) over; l'été müßig -- niño... ÀB! a1b2 x_y!?", "one\ntwo  three \n four. A.B c\u2019est 3.14 <s> </s> \u0130x! TAR\u0130H\u0130. \u0130, " + " a".join(self.special).lower() + " " + "!x".join(self.special).upper()):
            (ids,) = self._encode([text], self.full)
            if not np.array_equal(self.of([text])[0][:-1], ids):
                raise ValueError("this tokenizer doesn't treat words apart; its ids can't be looked up by word")
        self.clear()

    def clear(self) -> None:
        """Forget all words. Number 0 is the empty word, number 1 the end of a text (no word has a line break)."""
        self.words = pa.array(["", "\n"], pa.large_string())
        self.flat, self.length, self.met = np.array([END_ID], self.kind), np.array([0, 1]), np.full(2, 1 << 30)

    def _forget(self) -> None:
        """Keep the words that came up again, the latest of them if they are too many."""
        often = np.flatnonzero(self.met > 1)
        kept = np.concatenate(([0, 1], often[often > 1][-REMEMBERED // 2 :]))
        self.flat = _runs(self.flat, np.cumsum(self.length) - self.length, self.length, kept)
        self.words, self.length, self.met = self.words.take(pa.array(kept)), self.length[kept], np.minimum(self.met[kept], 1)
        self.met[:2] = 1 << 30

    def _encode(self, texts: list[str], steps: tuple) -> list[np.ndarray]:
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = steps
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        runs = self._encode(words, self.full)
        return np.concatenate(runs), np.array([len(r) for r in runs], np.int64)

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of lower-case Latin-1 letters, encoded as one text of many words."""
        (ids,) = self._encode([" ".join(words)], self.short)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):  # a vocabulary without that suffix
            return self._plain(words)
        return ids, np.diff(stops, prepend=0)

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """The numbers of distinct words, new ones of which are encoded."""
        if len(self.words) > REMEMBERED:
            self._forget()
        number = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(number < 0)
        if len(new):
            some = words.take(pa.array(new))
            short = pc.and_(pc.and_(pc.utf8_is_alpha(some), pc.utf8_is_lower(some)), pc.match_substring_regex(some, LATIN)).to_numpy(zero_copy_only=False)
            runs, lengths = [self.flat], [self.length]
            order = np.concatenate((np.flatnonzero(short), np.flatnonzero(~short)))
            for encode, mine in ((self._letters, order[: short.sum()]), (self._plain, order[short.sum() :])):
                for i in range(0, len(mine), 4000):
                    ids, n = encode(some.take(pa.array(mine[i : i + 4000])).to_pylist())
                    runs.append(ids)
                    lengths.append(n)
            number[new[order]] = len(self.words) + np.arange(len(new))
            self.words = pa.concat_arrays([self.words, some.take(pa.array(order))])
            self.flat, self.length = np.concatenate(runs), np.concatenate(lengths)
            self.met = np.append(self.met, np.zeros(len(new), np.int64))
        self.met[number] += 1
        return number

    def of(self, texts: list[str | None] | pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
        """The ids of each text with the end id, as 32-bit numbers."""
        column = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if not len(column):
            return []
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(column, ""), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        # In Latin-1 lower case is one character for one, as the tokenizer's is.
        lower = pc.if_else(pc.match_substring_regex(words, LATIN), pc.utf8_lower(words), words)
        for token in self.special:
            lower = pc.if_else(pc.match_substring(words, token, ignore_case=True), words, lower)
        bare = pc.utf8_rtrim(lower, characters=punctuation)
        # The capital I with a dot is a letter, but in lower case it ends in a mark, which joins those that follow.
        marked = pc.and_(pc.and_(pc.not_equal(bare, lower), pc.utf8_is_alpha(bare)), pc.invert(pc.match_substring(bare, "\u0130")))
        # A word is a stem and a mark, either of which may be empty; number 1 ends a text.
        stem = pc.if_else(marked, bare, lower).dictionary_encode()
        mark = pc.if_else(marked, pc.replace_substring_regex(lower, r"^.*?([!-/:-@\[-`{-~]*)$", r"\1"), "").dictionary_encode()
        known = pa.concat_arrays([stem.dictionary, mark.dictionary]).dictionary_encode()
        number = self._numbers(known.dictionary)[known.indices.to_numpy()]
        pairs = np.stack((number[stem.indices.to_numpy()], number[len(stem.dictionary) + mark.indices.to_numpy()]), 1)
        ids = _runs(self.flat, np.cumsum(self.length) - self.length, self.length, pairs.ravel())
        # The table of this batch: its words, and the end of a text.
        ids, lengths = np.append(ids, END_ID).astype("<u4"), np.append(self.length[pairs].sum(axis=1), 1)
        stops = np.diff(split.offsets.to_numpy()).cumsum()
        numbers = np.insert(coded.indices.to_numpy(), stops, len(words))
        ends = np.cumsum(lengths[numbers])[stops + np.arange(len(stops))]
        return np.split(_runs(ids, np.cumsum(lengths) - lengths, lengths, numbers), ends[:-1])


def _runs(flat: np.ndarray, start: np.ndarray, length: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Runs of `flat`, by number, one after the other."""
    n = length[which]
    at = np.repeat(start[which] - (np.cumsum(n) - n), n)
    at += np.arange(len(at))
    return flat[at]


class Index:
    """BM25 over the documents of a shard, by token id.

    Weights of terms that many documents have stand in dense rows, of the others in postings.
    """

    def __init__(self, docs: list[np.ndarray]):
        lengths = np.array([len(d) for d in docs])
        self.n = n = len(docs)
        key = np.concatenate(docs).astype(np.uint64) * np.uint64(n) + np.repeat(np.arange(n, dtype=np.uint64), lengths)
        key.sort()
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        tf, key = np.diff(np.append(first, len(key))), key[first]
        term, doc = key // np.uint64(n), (key % np.uint64(n)).astype(np.int64)
        start = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
        df = np.diff(np.append(start, len(term)))
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths[doc] / max(1.0, lengths.mean()))
        weight = (np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm)).astype(np.float32)
        # Terms of one document score nothing for others.
        dense, sparse = df * DENSE_SHARE >= n, (df > 1) & (df * DENSE_SHARE < n)
        self.row = np.full(int(term[-1]) + 1 if len(term) else 1, -1, np.int64)
        self.at = self.row.copy()
        terms = term[start].astype(np.int64)
        self.row[terms[dense]] = np.arange(int(dense.sum()))
        self.at[terms[sparse]] = np.arange(int(sparse.sum()))
        self.dense = np.zeros((int(dense.sum()), n), np.float32)
        mine = np.repeat(dense, df)
        self.dense[np.repeat(np.arange(len(self.dense)), df[dense]), doc[mine]] = weight[mine]
        mine = np.repeat(sparse, df)
        self.doc, self.weight = doc[mine], weight[mine]
        self.start = np.append(0, np.cumsum(df[sparse]))

    def nearest(self, query: np.ndarray, unused: np.ndarray) -> list[int]:
        """Unused documents by falling score for all terms of the query that others have too."""
        seen = np.zeros(len(self.row), bool)
        seen[query[query < len(seen)]] = True
        terms = np.flatnonzero(seen)
        rows, at = self.row[terms], self.at[terms]
        score = self.dense[rows[rows >= 0]].sum(axis=0)
        at = at[at >= 0]
        if len(at):
            sizes = self.start[at + 1] - self.start[at]
            ends = np.cumsum(sizes)
            places = np.repeat(self.start[at] - (ends - sizes), sizes) + np.arange(ends[-1])
            score = score + np.bincount(self.doc[places], self.weight[places], self.n)
        score[~unused] = 0
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")].tolist()


class Packer:
    """The pieces of a stream of shards; `pieces` holds those not taken yet."""

    def __init__(self, first_sequence: int, window: int = WINDOW):
        self.sequence, self.window = first_sequence, window
        self.open: list[tuple] = []  # pieces of the open window: doc_id, start, ids, doc_tokens
        self.fill = 0
        self.seed: np.ndarray | None = None  # the ids of the document that opened it
        self.pieces: list[tuple] = []

    def _close(self) -> None:
        offset = 0
        for doc_id, start, ids, total in self.open:
            self.pieces.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1
        self.open, self.fill = [], 0

    def _place(self, doc_id: int | None, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            if not self.fill:
                self.seed = ids
            part = ids[at : at + self.window - self.fill]
            self.open.append((doc_id, at, part, len(ids)))
            self.fill += len(part)
            at += len(part)
            if self.fill == self.window:
                self._close()

    def shard(self, doc_ids: list[int | None], docs: list[np.ndarray]) -> None:
        index, unused, next_one = Index(docs), np.ones(len(docs), bool), 0
        for _ in range(len(docs)):
            # The next document in order, or the nearest ones of the seed of the window that is open.
            near = index.nearest(self.seed, unused) if self.fill else []
            if not near:
                while next_one < len(docs) and not unused[next_one]:
                    next_one += 1
                if next_one == len(docs):
                    return
                near = [next_one]
            sequence = self.sequence
            for i in near:
                self._place(doc_ids[i], docs[i])
                unused[i] = False
                if self.sequence != sequence or not self.fill:
                    break

    def finish(self) -> None:
        """The open window, cut into sequences of falling powers of two."""
        left, pieces = self.fill, self.open
        while left:
            size = 1 << (left.bit_length() - 1)
            self.open, rest = [], []
            room = size
            for doc_id, start, ids, total in pieces:
                if room:
                    self.open.append((doc_id, start, ids[:room], total))
                if len(ids) > room:
                    rest.append((doc_id, start + room, ids[room:], total))
                room -= min(room, len(ids))
            self._close()
            left, pieces = left - size, rest


_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@functools.cache
def _ids(path: str) -> WordIds:
    return WordIds(path)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """The pieces of all of `docs`, by the tokenizer file at `tokenizer` (a path that executors have)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _ids(tokenizer)
        packer = Packer(TaskContext.get().partitionId() << 36, window)

        def shard(held: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(held)
            packer.shard(rows.column(0).to_pylist(), words.of(rows.column(1)))

        def taken() -> pa.RecordBatch:
            columns = list(zip(*packer.pieces, strict=True)) or [()] * 7
            packer.pieces = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in _SCHEMA.split(", ")])

        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= SHARD_ROWS or sum(x.nbytes for x in held) >= SHARD_BYTES:
                shard(held)
                held = []
                yield taken()
        if held:
            shard(held)
        packer.finish()
        yield taken()
        del held
        release_memory()

    return docs.select("doc_id", "text").mapInArrow(run, _SCHEMA)
