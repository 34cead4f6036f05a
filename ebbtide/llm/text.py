"""What the corpus operators share: words, row identities and public tokenizers."""

import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space; ``bytes.split()`` cuts at the same places.
WORD = r"[^\x20\x09-\x0D]+"

#: Identity of a row for operators that order documents: rows with equal text and doc_id are one document.
#: Null ids sort last.
LAST_ID = 2**63 - 1


def order_id(column="doc_id"):
    return F.coalesce(F.col(column).cast("long"), F.lit(LAST_ID))


def row_hash(id_column="doc_id", text_column="text"):
    return F.xxhash64(F.col(id_column), F.col(text_column))


def whole_text(column="text"):
    """The whole text; null is empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_bytes(column="text"):
    """The whole text as UTF-8 bytes; null is empty."""
    return whole_text(column).cast("binary")


def vocabulary(name):
    return public_tokenizers.path(name)


# Letters whose lower case is one letter, too (U+0130 is not).
_LATIN = re.compile("[A-Za-zÀ-įı-ɏ]+")
_PARTS = re.compile("[A-Za-z]+|[0-9]|[^A-Za-z0-9]+")


class WordEncoder:
    """Ids of whole texts, encoded word by word.

    The vocabulary drops white space and never merges across it, so a text's ids are those of its words in order. A
    group of texts is cut into words and its distinct words are looked up among those the library has encoded before;
    only new words go to it. ``limit`` bounds how many words are remembered, in flat arrays.
    """

    #: Words are handed to the library many at a time, with a space between them.
    JOINED = 200

    def __init__(self, path, limit=400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends_word[i] = token.endswith("</w>")
        self.words = pa.array([], pa.string())
        self.ids = np.empty(0, np.uint32)
        self.ends = np.zeros(1, np.int64)

    @staticmethod
    def _parts(word):
        """Number of parts that the vocabulary's pattern cuts a word into, where that is plain; else 0."""
        if word.isalpha():
            return 1 if _LATIN.fullmatch(word) else 0
        if word.isascii() and word.isprintable() and "'" not in word and "<|" not in word:
            return len(_PARTS.findall(word))
        return 0

    def _learn(self, words):
        """Append the ids of words not known yet; the words in the order in which they were appended."""
        plain, counts, rest = [], [], []
        for word in words.to_pylist():
            n = self._parts(word)
            if n:
                plain.append(word)
                counts.append(n)
            else:
                rest.append(word)
        joined = [" ".join(plain[i : i + self.JOINED]) for i in range(0, len(plain), self.JOINED)]
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.array([i for part in encoded for i in part], np.uint32)
        # Every part of a word ends with an id that ends a word, and no other does.
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        ends = ends[np.cumsum(counts, dtype=np.int64) - 1] if plain else np.empty(0, np.int64)
        alone = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
        sizes = np.cumsum([len(e.ids) for e in alone], dtype=np.int64)
        added = pa.array(plain + rest, pa.string())
        self.words = pa.concat_arrays([self.words, added])
        start = len(self.ids)
        self.ids = np.concatenate([self.ids, ids, *[np.array(e.ids, np.uint32) for e in alone]])
        self.ends = np.concatenate([self.ends, start + ends, start + len(ids) + sizes])
        return added

    def _keep(self, rows):
        """Forget all words but those in the given rows."""
        sizes = self.ends[rows + 1] - self.ends[rows]
        ends = np.cumsum(sizes)
        source = np.repeat(self.ends[rows] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))
        self.words = self.words.take(pa.array(rows))
        self.ids, self.ends = self.ids[source], np.concatenate([[0], ends])

    def _known(self, distinct):
        """Row of each distinct word among those known. With too many known, only those at hand are kept."""
        row = pc.index_in(distinct, value_set=self.words)
        if len(self.words) > self.limit:
            self._keep(np.sort(row.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)))
            row = pc.index_in(distinct, value_set=self.words)
        is_new = pc.is_null(row)
        new = distinct.filter(is_new)
        row = pc.fill_null(row, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(new):
            first = len(self.words)
            added = self._learn(new)
            row[is_new.to_numpy(zero_copy_only=False)] = first + pc.index_in(new, value_set=added).to_numpy()
        return row

    def encode_group(self, texts: pa.Array):
        """(ids of all texts one after the other, end of each text's ids) for an array of strings without nulls."""
        # The vocabulary is lower case. Special tokens are recognised before that, so texts with such marks stay.
        marked = pc.match_substring(texts, "<|")
        words = pc.ascii_split_whitespace(pc.if_else(marked, texts, pc.ascii_lower(texts)))
        coded = words.flatten().dictionary_encode()
        if not len(coded):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        row = self._known(coded.dictionary)[coded.indices.to_numpy()]
        sizes = self.ends[row + 1] - self.ends[row]
        ends = np.cumsum(sizes)
        source = np.repeat(self.ends[row] - (ends - sizes), sizes)
        source += np.arange(len(source))
        counts = np.asarray(words.value_lengths()).astype(np.int64)
        last = np.cumsum(counts)
        return self.ids[source], np.concatenate([[0], ends])[last]

    def encode_all(self, texts: pa.Array, group_chars=3_000_000):
        """(ids, ends) as ``encode_group``, for groups of texts of bounded size: yields (first text, ids, ends)."""
        sizes = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64))
        first = 0
        while first < len(texts):
            before = sizes[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(sizes, before + group_chars, side="right")))
            yield first, *self.encode_group(texts.slice(first, last - first))
            first = last
        pa.default_memory_pool().release_unused()

    def encode_each(self, texts: pa.Array):
        """Ids of each text as an array of unsigned 32-bit numbers."""
        for _, ids, ends in self.encode_all(texts):
            yield from np.split(ids, ends[:-1])


_HELD: dict = {}


def held(key, build):
    """What a worker process keeps from task to task: one large thing at a time, so that stages do not add up."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = build()
    return _HELD[key]


def parts(texts: pa.Array, size=400):
    """Lists of so many values each: a batch is never there as Python strings as a whole."""
    for first in range(0, len(texts), size):
        yield texts.slice(first, size).to_pylist()
    pa.default_memory_pool().release_unused()


def word_encoder(path) -> WordEncoder:
    """One encoder for each worker process, until another stage takes its place."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return held(("words", path), lambda: WordEncoder(path))
