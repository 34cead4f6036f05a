"""Substring dedup by sliding sentence spans: sentences inside a repeated run go, but for its first place."""

import re
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.text import order_id, row_hash, text_bytes
from ebbtide.session import materialized

#: A span is the shortest run of at least so many sentences that has at least so many words.
SENTENCES = 2
WORDS = 12
#: A sentence ends at . ! ? and the white space behind it or at a line's end. One with more words is cut further,
#: behind one word in CUT_ONE_IN on average, chosen by the word itself, so that equal stretches are cut alike.
LONGEST = 25
CUT_ONE_IN = 6

_END = re.compile(rb"[.!?]+[\x20\t\r\x0b\x0c]+|[\x20\t\r\x0b\x0c]*\n\s*")
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def sentences_of(text: bytes, longest=LONGEST):
    """Ends of the pieces that tile a text, and the words of each (lower case, ASCII only)."""
    ends, words = [], []
    start = 0
    for end in [*[m.end() for m in _END.finditer(text)], len(text)]:
        if end <= start:
            continue
        found = text[start:end].lower().split()
        if len(found) <= longest:
            ends.append(end)
            words.append(found)
        else:
            places = [m.start() for m in _WORD.finditer(text, start, end)]
            first = 0
            for i in [k for k, w in enumerate(found, 1) if k == len(found) or zlib.crc32(w) % CUT_ONE_IN == 0]:
                ends.append(places[i] if i < len(found) else end)
                words.append(found[first:i])
                first = i
        start = end
    return ends, words


def spans_of(text: bytes, sentences=SENTENCES, least_words=WORDS, longest=LONGEST):
    """(first sentence, number of sentences, hash) of the span that starts at each sentence; spans may overlap."""
    import xxhash

    _, words = sentences_of(text, longest)
    sizes = [len(w) for w in words]
    joined = [b" ".join(w) for w in words]
    out = []
    end, total = 0, 0
    for start in range(len(words)):
        while end < len(words) and (end - start < sentences or total < least_words):
            total += sizes[end]
            end += 1
        if end - start < sentences or total < least_words:
            break
        out.append((start, end - start, xxhash.xxh64_intdigest(b" ".join(joined[start:end])) - 2**63))
        total -= sizes[start]
    return out


def places_in_text(text: bytes, sentences=SENTENCES, least_words=WORDS, longest=LONGEST):
    """(spans at their first place in a text, stretches of sentences that repeat spans of the same text)."""
    firsts, stretches, seen = [], [], set()
    for at, n, span in spans_of(text, sentences, least_words, longest):
        if span not in seen:
            seen.add(span)
            firsts.append((at, n, span))
        elif stretches and at <= stretches[-1][0] + stretches[-1][1]:
            start = stretches[-1][0]
            stretches[-1] = (start, max(at + n, sum(stretches[-1])) - start)
        else:
            stretches.append((at, n))
    return firsts, stretches


def span_table(docs: DataFrame, sentences=SENTENCES, least_words=WORDS, longest=LONGEST) -> DataFrame:
    """``id, h, at, n, span``: every span of every document at its first place there.

    Later places in the same document are stretches with a null span: they are repeats whatever other texts hold, so
    a text that says one thing over and over is one row for each thing.
    """
    columns = ["id", "h", "at", "n", "span"]

    def frame(rows):
        return pd.DataFrame({c: pd.array(list(v), "Int64") for c, v in zip(columns, zip(*rows))})

    def spans(batches):
        for batch in batches:
            found = []
            for i, h, text in zip(batch["id"].tolist(), batch["h"].tolist(), batch["text"]):
                firsts, stretches = places_in_text(text, sentences, least_words, longest)
                found += [(i, h, *span) for span in firsts]
                found += [(i, h, *stretch, None) for stretch in stretches]
                if len(found) > 100_000:
                    yield frame(found)
                    found = []
            if found:
                yield frame(found)

    rows = docs.select(order_id().alias("id"), row_hash().alias("h"), text_bytes().alias("text"))
    return rows.mapInPandas(spans, "id long, h long, at int, n int, span long")


def covered_sentences(docs: DataFrame, sentences=SENTENCES, least_words=WORDS, longest=LONGEST) -> DataFrame:
    """``id, h, places``: for documents that repeat a span, the (first, number) of its sentences.

    A span stays where the smallest doc_id has it first. Counts and smallest ids are merged before they meet, and are
    written before they are looked up, so that the join can split a span that very many documents have.
    """
    spans = materialized(span_table(docs, sentences, least_words, longest), "spans")
    shared = spans.where("span is not null")
    repeated = shared.groupBy("span").agg(F.count("*").alias("times"), F.min("id").alias("first_id")).where("times > 1")
    repeated = materialized(repeated.drop("times"), "span-counts")
    place = ["id", "h", F.struct("at", "n").alias("place")]
    later = shared.join(repeated, "span").where(F.col("id") != F.col("first_id")).select(*place)
    within = spans.where("span is null").select(*place)
    return later.union(within).groupBy("id", "h").agg(F.collect_set("place").alias("places"))


def without_repeated_spans(docs: DataFrame, sentences=SENTENCES, least_words=WORDS, longest=LONGEST) -> DataFrame:
    """``row, cleaned, n_sentences, removed`` for every row of ``docs``; row holds all its columns.

    removed lists (start, end) of the parts taken out, in characters of the text. Null ids come last and count as one
    id. Rows with equal doc_id and text get equal results; rows that share a doc_id lose no spans to each other. A text with fewer sentences or words than a span stays as it is, null stays
    null. Other columns may have any name; an empty table gives no rows.
    """
    found = covered_sentences(docs.select("doc_id", "text"), sentences, least_words, longest)
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), order_id().alias("id"), row_hash().alias("h")
    )
    joined = whole.join(found, ["id", "h"], "left")

    @F.pandas_udf("cleaned string, n_sentences int, removed array<struct<start:int,end:int>>")
    def cut(texts: pd.Series, places: pd.Series) -> pd.DataFrame:
        out = []
        for text, spans in zip(texts, places):
            if text is None or spans is None:
                out.append((None, 0, None))
                continue
            ends, _ = sentences_of(text, longest)
            gone = set()
            for span in spans:
                gone.update(range(span["at"], span["at"] + span["n"]))
            kept, removed, start, at = [], [], 0, 0
            for k, end in enumerate(ends):
                part = text[start:end].decode("utf-8", "replace")
                if k in gone:
                    if removed and removed[-1]["end"] == at:
                        removed[-1]["end"] = at + len(part)
                    else:
                        removed.append({"start": at, "end": at + len(part)})
                else:
                    kept.append(part)
                start, at = end, at + len(part)
            out.append(("".join(kept), len(ends), removed))
        return pd.DataFrame(out, columns=["cleaned", "n_sentences", "removed"])

    text = F.col("row")["text"]
    changed = F.col("places").isNotNull()
    done = joined.withColumn("cut", cut(F.when(changed, text.cast("binary")), F.col("places")))
    return done.select(
        "row",
        F.when(changed, F.col("cut.cleaned")).otherwise(text).alias("cleaned"),
        F.coalesce(F.col("cut.removed"), F.array().cast("array<struct<start:int,end:int>>")).alias("removed"),
    )
