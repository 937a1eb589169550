"""Quality rules: counts of words, symbols and repeats, and perplexity bands per language.

Perplexities come from a modified Kneser-Ney model over the last five characters, whole code points, that Spark counts,
derives and stores as sorted hash arrays (`char_model.py`).  Texts are dealt to blocks of bounded size and travel compressed;
the task that scores a block receives the scores of its n-grams and no others.  A document counts for the language whose
character pairs fit it best, so a wrong label neither spoils a model nor condemns a clean text.  The band of a language is
taken on each side from the spread of its documents' log perplexities on that side."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from balsam.llm.char_model import SHARD_CHARS, Block, Dealer, count_grams, derive_model, learn_languages, score_blocks
from balsam.llm.common import chunks, discard, mix64, release_shuffles, settle, word_hashes, word_spans

#: A document is out of its language's band beyond so many standard deviations of its side from the median; a side's
#: standard deviation is read off its outer tenth.
BAND_DEVIATIONS, TENTH = 5.0, 1.2816
MIN_WORDS, REPEAT_PERCENT = 50, 50
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True

RULE_SCHEMA = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
               "base_failed boolean, log_perplexity double")


def rule_counts(x: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of texts laid end to end."""
    n = len(at) - 1
    starts, ends, first = word_spans(x, at)
    per_text = lambda flags: np.diff(np.append(0, np.cumsum(flags))[at])
    inside = np.zeros(len(x) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    chars = per_text((np.cumsum(inside[:-1]) > 0) & ((x & 0xC0) != 0x80))
    words = word_hashes(x, starts, ends)
    text_of = np.repeat(np.arange(n, dtype=np.uint64), np.diff(first))
    repeated = np.zeros(len(words), bool)
    if len(words) > 2:
        k = np.uint64(0x9FB21C651E98DF25)
        three = mix64(mix64((words[:-2] * k + words[1:-1]) * k + words[2:]) + text_of[:-2] * k)
        real = text_of[:-2] == text_of[2:]
        order = np.argsort(three[real])
        s = three[real][order]
        same = np.zeros(len(s), bool)
        same[1:] = s[1:] == s[:-1]
        same[:-1] |= same[1:]
        at3 = np.flatnonzero(real)[order[same]]
        for i in range(3):
            repeated[at3 + i] = True
    n_repeat = np.diff(np.append(0, np.cumsum(repeated))[first])
    # Lines: cut at line feeds and at the texts' bounds.
    feeds = np.flatnonzero(x == 10)
    begins = np.concatenate([at[:-1], feeds + 1])
    stops = np.concatenate([feeds, at[1:]])
    owner = np.concatenate([np.arange(n), np.searchsorted(at, feeds, "right") - 1])
    by_begin = np.lexsort((begins, owner))
    begins, owner = begins[by_begin], owner[by_begin]
    owner_stop = np.concatenate([np.searchsorted(at, feeds, "right") - 1, np.arange(n)])
    stops = stops[np.lexsort((stops, owner_stop))]
    worded = np.searchsorted(starts, begins) < np.searchsorted(starts, stops)
    begins, stops, owner = begins[worded], stops[worded], owner[worded]
    lines = word_hashes(x, begins, stops)
    lines = mix64(lines + owner.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    order = np.argsort(lines, kind="stable")
    again = np.zeros(len(lines), bool)
    again[order[1:]] = lines[order][1:] == lines[order][:-1]
    n_dup = np.bincount(owner[again], minlength=n)
    return [np.diff(first), chars, per_text(_SYMBOLS[x]), n_dup, n_repeat]


def _measure(docs: DataFrame, columns: list[str], stored: bool) -> DataFrame:
    """`columns` of rows (lang, text, ...) with the language that fits, the rule counts and the log perplexity a character."""
    added = [c.split(" ")[0] for c in RULE_SCHEMA.split(", ")]
    names = [f"c{i}" for i in range(len(columns))]
    picked = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
                         F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                         *[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)])
    # Counting and dealing must see the same rows in the same order; files give them, a shuffle need not.
    source = picked if stored else settle(picked)
    learned = learn_languages(source.select("lang", "text"))
    fitted, shards = learned.names, max(8, learned.chars // SHARD_CHARS)
    languages = docs.sparkSession.sparkContext.broadcast(learned)
    counted = settle(count_grams(source, languages, shards))
    model = derive_model(counted, fitted)
    scores = settle(score_blocks(counted, model.scores))
    model.discard()
    discard(counted)
    release_shuffles(docs.sparkSession)  # before the texts travel

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(languages.value)
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
        for batch in batches:
            for lang, block, rows in dealer.deal(batch):
                for first, end, _, _ in chunks(rows.column(1)):
                    part, sink = rows.select(["text", *names]).slice(first, end - first), pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, part.schema, options=options) as out:
                        out.write_batch(part)
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([lang], pa.int32()),
                                                      pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "fitted", "rows"])

    def run(texts: pa.Table, scores: pa.Table) -> pa.Table:
        lang = texts.column("fitted")[0].as_py()
        block, chunked = Block(lang, shards), []
        # The rows of a block arrive in any order: its n-grams are the same, and so is their order.
        for packed in texts.column("rows"):
            for part in pa.ipc.open_stream(packed.as_buffer()):
                for first, end, x, at, bounds in block.add(part.column(0)):
                    chunked.append((part.slice(first, end - first).columns[1:], rule_counts(x, at), bounds))
        block.close()
        order = np.argsort(scores.column("shard").to_numpy())
        found = scores.column("scores").to_pylist()
        value = np.frombuffer(b"".join(found[i] for i in order), np.float32).astype(np.float64)
        if len(value) != len(block.hi):
            raise RuntimeError("the rows changed when they were read again: pass stored=False")
        out = []
        for (kept, counts, bounds), (place, which) in zip(chunked, block.places, strict=True):
            chars = np.diff(bounds)
            sums = np.append(0, np.cumsum(value[place][which]))[bounds]
            nats = np.divide(-np.diff(sums), chars, out=np.zeros(len(chars)), where=chars > 0)
            failed = (counts[0] < MIN_WORDS) | (100 * counts[4] > REPEAT_PERCENT * counts[0])
            out.append(pa.RecordBatch.from_arrays(
                [pa.array([fitted[lang]] * len(chars), pa.string()), *kept, *[pa.array(c, pa.int64()) for c in counts],
                 pa.array(failed, pa.bool_()), pa.array(nats, pa.float64())], ["fitted", *names, *added]))
        return pa.Table.from_batches(out)

    kinds = {n: picked.schema[n].dataType for n in names}
    schema = ", ".join(["fitted string", *[f"{n} {t.simpleString()}" for n, t in kinds.items()], RULE_SCHEMA])
    dealt = source.mapInArrow(deal, "block bigint, fitted int, rows binary")
    out = dealt.groupBy("block").cogroup(scores.groupBy("block")).applyInArrow(run, schema)
    out = settle(out.select(F.col("fitted").alias("__fitted"), *[F.col(n).alias(c) for c, n in zip(columns, names, strict=True)], *added))
    discard(scores, *([] if stored else [source]))
    return out


def perplexity_bands(measured: DataFrame) -> dict[str, tuple[float, float]]:
    """Lower and upper log perplexity per language, from rows (lang, base_failed, log_perplexity).

    Each side has its own width, and nothing opens a band by force: its edge lies BAND_DEVIATIONS standard deviations from
    the median, as the documents on that side that pass the base rules spread.  Copies count once."""
    rows = measured.where("not base_failed").select("lang", "log_perplexity").distinct().groupBy("lang").agg(
        F.percentile_approx("log_perplexity", [0.1, 0.5, 0.9], 10_000).alias("q")).collect()
    out = {}
    for row in rows:
        low, middle, high = row["q"]
        out[row["lang"]] = tuple(middle + BAND_DEVIATIONS * (edge - middle) / TENTH for edge in (low, high))
    return out


def apply_rules(docs: DataFrame, columns: list[str] | None = None, stored: bool = False) -> DataFrame:
    """`columns` of `docs` (default: doc_id) with counts, base_failed, log_perplexity and `kept`, row by row.

    Needs columns lang and text; a null text has no words and fails the base rules, a null language is
    one of its own.  Rows with null or repeated ids are judged as any other; `columns` may not clash
    with the added names; an empty table gives no rows.  `docs` is read three times: `stored` says that it reads files
    (with at most narrow steps after), which give the same rows again; other tables are written first."""
    columns = columns or ["doc_id"]
    measured = _measure(docs.withColumn("__l", F.coalesce(F.col("lang").cast("string"), F.lit(""))), ["__l", *columns], stored)
    bands = perplexity_bands(measured.select(F.col("__fitted").alias("lang"), "base_failed", "log_perplexity"))
    inside = F.lit(True)  # languages are few: as many as bands
    for name, (low, high) in sorted(bands.items()):
        inside = F.when(F.col("__fitted") == name, F.col("log_perplexity").between(low, high)).otherwise(inside)
    judged = measured.withColumn("kept", ~F.col("base_failed") & inside).drop("__fitted")
    return judged.withColumnRenamed("__l", "lang") if columns == ["doc_id"] else judged.drop("__l")
