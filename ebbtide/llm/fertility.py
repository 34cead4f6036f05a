"""Quality rules by tokeniser fertility: how a public vocabulary cuts a text tells prose from junk."""

import functools
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.llm.tables import with_size_checked
from ebbtide.llm.text import text_bytes, vocabulary
from ebbtide.session import materialized

LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
WINDOW = 8

#: A measure's band reaches so many quartile ranges beyond the quartiles of its language and size of text,
#: and at least so far from them.
QUARTILE_RANGES = 3.0
LEAST_MARGIN = {"chars_per_token": 0.12, "byte_share": 0.05, "token_entropy": 0.3}
#: Groups with fewer texts have no band of their own; that of the next wider group holds.
LEAST_GROUP = 50
#: Decimals that quartiles are found in: a group then has at most some ten thousand values of a measure.
DECIMALS = {"chars_per_token": 3, "byte_share": 4, "token_entropy": 3}
#: From the narrowest group to all texts.
GROUPS = [["kind", "size_class"], ["kind"], ["script"], []]

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"


class PieceCounter:
    """Token ids of words under a vocabulary with byte fallback; each distinct word is encoded once and remembered."""

    def __init__(self, path, limit=200_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.limit = limit
        self.known = {}

    def learn(self, words):
        if len(self.known) > self.limit:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        encoded = self.model.encode([w.decode("utf-8", "replace") for w in new], num_threads=1) if new else []
        self.known.update((w, np.array(ids, np.int32)) for w, ids in zip(new, encoded))

    def measures(self, counts):
        """(tokens, byte tokens, entropy of the tokens in bits) of a bag of words that were learnt."""
        if not counts:
            return 0, 0, 0.0
        ids = [self.known[w] for w in counts]
        times = np.repeat(np.fromiter(counts.values(), np.int64, len(counts)), [len(x) for x in ids])
        tokens, place = np.unique(np.concatenate(ids), return_inverse=True)
        n = np.bincount(place, weights=times)
        total = int(n.sum())
        share = n[n > 0] / max(total, 1)
        return total, int(n[self.is_byte[tokens]].sum()), float(-(share * np.log2(share)).sum()) + 0.0


@functools.lru_cache(maxsize=2)
def piece_counter(path):
    return PieceCounter(path)


def repeated_window_words(words, window=WINDOW):
    """Words inside runs of ``window`` words that occur twice or more in the text, the first ones included.

    Runs are numbered exactly: equal pairs get equal numbers, then equal pairs of pairs, and so on.
    """
    number = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(ids) <= window or len(number) == len(ids):
        return 0
    run = 1
    while run < window:
        step = min(run, window - run)  # overlapping halves do when the window is no power of two
        left, right = ids[: len(ids) - step], ids[step:]
        _, ids = np.unique(left * (int(ids.max()) + 1) + right, return_inverse=True)
        run += step
        if len(ids) == ids.max() + 1:
            return 0
    repeated = np.bincount(ids)[ids] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(repeated)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def repeated_lines(text: bytes):
    """Lines with a word that equal an earlier line."""
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip(_SPACE):
            seen.add(line)
    return n


MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_tokens long, n_byte_tokens long, token_entropy double, script string"
)

#: First code points of the scripts told apart; those before the first are Latin.
SCRIPTS = [
    (0x370, "greek"),
    (0x400, "cyrillic"),
    (0x530, "other"),
    (0x590, "hebrew"),
    (0x600, "arabic"),
    (0x780, "other"),
    (0x900, "indic"),
    (0x0E00, "southeast_asian"),
    (0x10A0, "other"),
    (0x1E00, "latin"),
    (0x1F00, "greek"),
    (0x2000, "other"),
    (0x3040, "japanese"),
    (0x3100, "other"),
    (0x3400, "han"),
    (0xA000, "other"),
    (0xAC00, "korean"),
    (0xD800, "other"),
]
# End of fixed values.


def script_of(text):
    """Script of most letters."""
    counts = Counter()
    for char, n in Counter(text).items():
        if char.isalpha():
            point, name = ord(char), "latin"
            for first, script in SCRIPTS:
                if point < first:
                    break
                name = script
            counts[name] += n
    return min(counts, key=lambda s: (-counts[s], s)) if counts else "none"


def measured(docs: DataFrame, path=None) -> DataFrame:
    """``docs`` with a struct column ``m``: base counts and token measures of each whole text (column of bytes)."""
    path = path or vocabulary("piece_bpe_32k.model")

    @F.pandas_udf(MEASURES)
    def measure(texts: pd.Series) -> pd.DataFrame:
        counter, out = piece_counter(path), []
        for text in texts:
            words = text.split()
            counts = Counter(words)
            counter.learn(counts)
            packed = text.translate(None, _SPACE)
            out.append(
                (
                    len(words),
                    len(packed.decode("utf-8", "replace")),
                    len(text) - len(text.translate(None, _SYMBOLS)),
                    repeated_lines(text),
                    repeated_window_words(words),
                    *counter.measures(counts),
                    script_of(packed.decode("utf-8", "replace")),
                )
            )
        return pd.DataFrame(out, columns=[c.split()[0] for c in MEASURES.split(", ")])

    return docs.withColumn("m", measure(text_bytes()))


def _cells(rows):
    """Texts per value of each measure in the narrowest groups; counts of wider groups are sums of these."""
    entries = [
        F.struct(F.lit(c).alias("measure"), F.round(c, d).alias("value")) for c, d in DECIMALS.items()
    ]
    keys = ["kind", "script", "size_class", "measure", "value"]
    return rows.select("kind", "script", "size_class", F.inline(F.array(*entries))).groupBy(*keys).agg(
        F.count("*").alias("n")
    )


def _bands(cells, groups, quartile_ranges):
    """Lower and upper end of every measure's band, from exact quartiles of the rounded values of a group."""
    of_group = Window.partitionBy(*groups, "measure")
    counted = cells.groupBy(*groups, "measure", "value").agg(F.sum("n").alias("n"))
    ranked = counted.withColumns(
        {"upto": F.sum("n").over(of_group.orderBy("value")), "n_texts": F.sum("n").over(of_group)}
    )
    ends = []
    for c, least in LEAST_MARGIN.items():
        lo, hi = [
            F.min(F.when((F.col("measure") == c) & (F.col("upto") >= F.ceil(q * F.col("n_texts"))), F.col("value")))
            for q in (0.25, 0.75)
        ]
        margin = F.greatest((hi - lo) * quartile_ranges, F.lit(least))
        ends += [(lo - margin).alias(f"{c}_from"), (hi + margin).alias(f"{c}_to")]
    return ranked.groupBy(*groups).agg(F.max("n_texts").alias("n_texts"), *ends)


def quality_verdicts(docs: DataFrame, path=None, quartile_ranges=QUARTILE_RANGES) -> DataFrame:
    """Base counts, token measures and verdict of every row of ``doc_id, text, lang``.

    Words are cut by the vocabulary one by one: chars_per_token over the words' characters, byte_share (tokens that
    are single bytes), token_entropy in bits. Texts are grouped by lang (null: by script) and by the power of two of
    their number of words, because entropy grows with length; a text outside a band of its group is not kept. Bands
    come from exact quartiles of all texts in the group, in steps of ``DECIMALS``. Groups of fewer than ``LEAST_GROUP``
    texts take the band of their language over all sizes, else of their script, else of all texts. Texts with too few words or too many
    words in repeated windows fail the base rules. A null text has no words. Repeated rows get equal results; other
    columns are not read; an empty table gives no rows.
    """
    m = F.col("m")
    rows = (
        measured(docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text"), path)
        .select(
            "doc_id",
            "m.*",
            F.coalesce("lang", F.concat(F.lit("script "), m["script"])).alias("kind"),
        )
        .withColumns(
            {
                "size_class": F.floor(F.log2(F.greatest("n_words", F.lit(1)))).cast("int"),
                "chars_per_token": F.when(F.col("n_tokens") > 0, F.col("word_chars") / F.col("n_tokens")),
                "byte_share": F.when(F.col("n_tokens") > 0, F.col("n_byte_tokens") / F.col("n_tokens")),
                "base_failed": (F.col("n_words") < LEAST_WORDS)
                | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")),
            }
        )
    )
    rows = materialized(rows, "fertility")
    cells = materialized(_cells(rows.where("n_tokens > 0")), "fertility-cells")
    ends = [f"{c}_{end}" for c in LEAST_MARGIN for end in ("from", "to")]
    banded = rows.withColumn("everything", F.lit(0))
    for i, groups in enumerate(GROUPS):
        bands = _bands(cells, groups, quartile_ranges)
        if groups:
            bands = bands.where(F.col("n_texts") >= LEAST_GROUP)
        else:  # one row, also of a table without tokens
            groups, bands = ["everything"], bands.withColumn("everything", F.lit(0))
        named = bands.drop("n_texts").withColumnsRenamed({e: f"{e}_{i}" for e in ends})
        banded = banded.join(with_size_checked(named), groups, "left")
    banded = banded.withColumns({e: F.coalesce(*[f"{e}_{i}" for i in range(len(GROUPS))]) for e in ends})
    inside = F.lit(True)
    for c in LEAST_MARGIN:
        inside = inside & F.coalesce(F.col(c).between(F.col(f"{c}_from"), F.col(f"{c}_to")), F.lit(True))
    return banded.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & inside).alias("kept"),
        "n_tokens",
        "chars_per_token",
        "byte_share",
        "token_entropy",
        "kind",
        *ends,
    )
