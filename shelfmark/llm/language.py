"""Operator 5: language identification by script, per-word scores and Viterbi with a switching penalty."""

from __future__ import annotations

import pickle
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lower, pieces, small_batches, summed, utf8

#: Hashed cells of byte trigrams (word edges included), in slices that are summed apart.
CELLS, SLICES = 1 << 15, 8
#: Log odds that a change of language from one word to the next costs.
SWITCH = 8.0
SMOOTH = 0.5
#: Unicode's ranges of the scripts. Only letters and marks in them count; letters elsewhere are `other`.
RANGES = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x250, 0x2AF), (0x300, 0x36F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB6F), (0xFB00, 0xFB06), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "armenian": ((0x531, 0x58F), (0xFB13, 0xFB17)),
    "hebrew": ((0x591, 0x5F4), (0xFB1D, 0xFB4F)),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x870, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC)),
    "devanagari": ((0x900, 0x97F), (0xA8E0, 0xA8FF)),
    "bengali": ((0x980, 0x9FF),),
    "gurmukhi": ((0xA00, 0xA7F),),
    "gujarati": ((0xA80, 0xAFF),),
    "odia": ((0xB00, 0xB7F),),
    "tamil": ((0xB80, 0xBFF),),
    "telugu": ((0xC00, 0xC7F),),
    "kannada": ((0xC80, 0xCFF),),
    "malayalam": ((0xD00, 0xD7F),),
    "sinhala": ((0xD80, 0xDFF),),
    "thai": ((0xE00, 0xE7F),),
    "lao": ((0xE80, 0xEFF),),
    "tibetan": ((0xF00, 0xFFF),),
    "myanmar": ((0x1000, 0x109F), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F)),
    "georgian": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)),
    "hangul": ((0x1100, 0x11FF), (0x3131, 0x318E), (0xA960, 0xA97F), (0xAC00, 0xD7FF)),
    "ethiopic": ((0x1200, 0x139F), (0x2D80, 0x2DDF), (0xAB00, 0xAB2F)),
    "khmer": ((0x1780, 0x17FF),),
    "mongolian": ((0x1800, 0x18AF),),
    "kana": ((0x3041, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D)),
    "han": ((0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)),
}
SCRIPTS = ("none", *RANGES, "other")
#: Code points beyond the table have no letters.
LAST_POINT = 0x323AF
#: A language is a candidate for a script if at least this share of its letters is in it.
SCRIPT_SHARE = 0.001
UNKNOWN = "und"
#: A text counts as in a learned language if its trigrams are likelier there than by even chance, by so much on
#: average (natural log), if letters (bytes) are this share of its bytes that aren't blank, and no more than half
#: of its letters are in scripts that nothing was learned in.
LEAST_GAIN, LEAST_LETTERS = 0.0, 0.2
SCHEMA = "doc_id long, lang_pred string, score double, spans string"


@lru_cache(maxsize=1)
def script_table() -> np.ndarray:
    """Number of the script of each code point, 0 for what is no letter or mark."""
    letter = np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(LAST_POINT + 1)), bool, LAST_POINT + 1)
    table = np.where(letter, SCRIPTS.index("other"), 0).astype(np.uint8)
    for name, ranges in RANGES.items():
        for low, high in ranges:
            table[low : high + 1] = np.where(letter[low : high + 1], SCRIPTS.index(name), 0)
    return table


def scripts_of(data: np.ndarray) -> np.ndarray:
    """Script of each byte of UTF-8 text: that of the code point it belongs to."""
    table = script_table()
    out = np.where(data < 128, table[np.minimum(data, 127)], 0)
    for low, high, size, bits in ((0xC0, 0xDF, 2, 0x1F), (0xE0, 0xEF, 3, 0x0F), (0xF0, 0xF7, 4, 0x07)):
        lead = np.flatnonzero((data >= low) & (data <= high))
        lead = lead[lead + size <= len(data)]
        point = (data[lead] & bits).astype(np.int64)
        for k in range(1, size):
            point = point << 6 | (data[lead + k] & 0x3F)
        script = np.where(point <= LAST_POINT, table[np.minimum(point, LAST_POINT)], 0)
        for k in range(size):
            out[lead + k] = script
    return out


def word_scripts(scripts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Script of each word: that of most of its bytes, the first in the list of scripts if several have as many."""
    if not len(first):
        return np.zeros(0, np.uint8)
    low, out = np.minimum.reduceat(scripts, first), np.maximum.reduceat(scripts, first)
    ends = np.append(first[1:], len(scripts))
    for k in np.flatnonzero(low != out).tolist():
        out[k] = np.bincount(scripts[first[k] : ends[k]]).argmax()
    return out


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(trigram cell of each letter byte, first cell of each word, script of each word, first word of each text)."""
    data = lower(data)
    scripts = scripts_of(data)
    letter = scripts > 0
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    begin = letter.copy()
    if n:
        begin[1:] &= ~letter[:-1] | edge[1:-1]
    before = np.concatenate(([0], np.where(letter, data, 0)[:-1])).astype(np.uint32) if n else np.zeros(0, np.uint32)
    before[begin] = 0
    after = np.concatenate((np.where(letter & ~begin, data, 0)[1:], [0])).astype(np.uint32) if n else before
    cell = ((before << np.uint32(16)) | (data.astype(np.uint32) << np.uint32(8)) | after) * np.uint32(2654435761) >> np.uint32(17)
    inside = np.flatnonzero(letter)
    first = np.searchsorted(inside, np.flatnonzero(begin))
    return cell[inside], first, word_scripts(scripts[inside], first), np.searchsorted(np.flatnonzero(begin), at)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram and script counts by language, a row for each slice, once for a task."""
    total: dict[str, np.ndarray] = {}
    for batch in pieces(batches):
        langs = batch.column("lang").to_pylist()
        cell, first, script, text = words_of(*utf8(batch.column("text")))
        ends = np.concatenate((first, [len(cell)]))[text]
        for lang in set(langs):
            rows = [i for i, x in enumerate(langs) if x == lang]
            into = total.setdefault(lang, np.zeros(CELLS + len(SCRIPTS), np.int64))
            into[:CELLS] += np.bincount(np.concatenate([cell[ends[i] : ends[i + 1]] for i in rows]), minlength=CELLS)
            into[CELLS:] += np.bincount(np.concatenate([script[text[i] : text[i + 1]] for i in rows]), minlength=len(SCRIPTS))
    for lang, counts in total.items():
        parts = [*np.split(counts[:CELLS], SLICES), counts[CELLS:]]
        task = pa.array([TaskContext.get().partitionId()] * len(parts), pa.int32())
        yield pa.RecordBatch.from_pydict({"lang": [lang] * len(parts), "slice": pa.array(range(len(parts)), pa.int32()), "task": task, "counts": [p.astype(np.int64).tobytes() for p in parts]})


class Model:
    """Languages, the log likelihood of each trigram cell, and which languages each script admits."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        cells = np.array([counts[x][:CELLS] for x in self.langs], float).reshape(-1, CELLS) + SMOOTH
        self.score = np.log(cells / cells.sum(1, keepdims=True)).T.astype(np.float32)
        self.level = self.score.mean(1) if self.langs else np.zeros(CELLS, np.float32)
        self.score -= self.level[:, None] if self.langs else 0
        seen = np.array([counts[x][CELLS:] for x in self.langs], float).reshape(-1, len(SCRIPTS))
        self.admits = (seen >= SCRIPT_SHARE * np.maximum(seen.sum(1, keepdims=True), 1)).T
        self.learned = self.admits.any(1)
        self.admits[~self.learned] = True

    def word_scores(self, cell: np.ndarray, first: np.ndarray, script: np.ndarray) -> np.ndarray:
        scores = np.add.reduceat(self.score[cell], first, axis=0).astype(np.float64)
        return np.where(self.admits[script], scores, scores - 50.0)


def learn(labelled: DataFrame) -> Model:
    """Counts over all labelled documents (text, lang), one small row set for each task and language, added up
    in levels; the model's size depends on the number of languages only. Rows without text or lang teach
    nothing; without any other row the model has no language."""
    small_batches(labelled.sparkSession)
    counts = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang").mapInArrow(_count, "lang string, slice int, task int, counts binary")
    rows = summed(counts, ("lang", "slice"), "int64").collect()  # a few rows for each language
    by: dict[str, dict[int, np.ndarray]] = {}
    for lang, part, data in rows:
        by.setdefault(lang, {})[part] = np.frombuffer(bytes(data), np.int64)
    return Model({lang: np.concatenate([parts[i] for i in range(SLICES + 1)]) for lang, parts in by.items()})


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word, where every change costs `switch`; ties go to the language that comes first."""
    n, k = scores.shape
    back = np.zeros((n, k), np.int16)
    best = scores[0].tolist()
    for i, row in enumerate(scores[1:].tolist(), 1):
        top = max(range(k), key=best.__getitem__)
        change = best[top] - switch
        back[i] = [j if best[j] >= change else top for j in range(k)]
        best = [max(b, change) + r for b, r in zip(best, row)]
    out = np.zeros(n, np.int16)
    out[-1] = max(range(k), key=best.__getitem__)
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def one_language(scores: np.ndarray, text: np.ndarray, switch: float) -> np.ndarray:
    """For each text the language that its best path keeps throughout, -1 where it may change.

    A path that leaves the best single language gains at most the largest sum of a run of words of
    what other languages score above it. If no run makes up for one change, none is worth it.
    """
    docs, words = len(text) - 1, np.diff(text)
    total = np.add.reduceat(np.vstack([scores, np.zeros((1, scores.shape[1]))]), text[:-1], axis=0)
    total[words == 0] = 0
    keep = total.argmax(1)
    doc = np.repeat(np.arange(docs), words)
    above = scores.copy()
    above[np.arange(len(scores)), keep[doc]] = -np.inf
    other = np.maximum(above.max(1, initial=-np.inf), -1e6) - scores[np.arange(len(scores)), keep[doc]]
    run = np.cumsum(other)
    before = run - other
    # the lowest sum so far within a text: texts are lifted apart so that one running minimum serves all
    lift = doc * (2 * (np.abs(run).max() if len(run) else 0) + 1)
    low = np.minimum.accumulate((before - lift)) + lift if len(run) else run
    best = np.maximum.reduceat(np.concatenate((run - low, [0.0])), np.minimum(text[:-1], len(run))) if docs else np.zeros(0)
    best[words == 0] = 0
    return np.where(best < switch, keep, -1)


def predict(model: Model, texts: pa.Array, switch: float = SWITCH) -> tuple[list[str], list[float], list[str]]:
    """(language, score, spans `lang:first word:end`) of each text."""
    return judge(model, texts, switch)[:3]


def judge(model: Model, texts: pa.Array, switch: float = SWITCH) -> tuple[list[str], list[float], list[str], np.ndarray]:
    """What predict() gives, and how much likelier the trigrams are, each word in the language that suits it best, than by even chance."""
    cell, first, script, text = words_of(*utf8(texts))
    langs, shares, spans = [], [], []
    scores = model.word_scores(cell, first, script) if len(first) and model.langs else np.zeros((len(first), len(model.langs)))
    fixed = one_language(scores, text, switch) if model.langs else None
    sums = lambda x, at: np.diff(np.concatenate(([0.0], np.cumsum(x, dtype=np.float64)))[at])
    ends = np.concatenate((first, [len(cell)]))[text]
    gains = (sums(scores.max(1, initial=-1e6), text) + sums(model.level[cell], ends)) / np.maximum(np.diff(ends), 1) + np.log(CELLS)
    for i in range(len(texts)):
        a, b = int(text[i]), int(text[i + 1])
        if a == b or not model.langs or not any(c.isalpha() for c in texts[i].as_py()):
            langs.append(UNKNOWN), shares.append(0.0), spans.append("")
            continue
        if fixed[i] >= 0:
            won, runs = int(fixed[i]), [(0, b - a, int(fixed[i]))]
            mine = np.ones(b - a, bool)
        else:
            path = viterbi(scores[a:b], switch)
            cut = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), b - a]
            runs = [(x, y, int(path[x])) for x, y in zip(cut, cut[1:])]
            won = int(np.bincount(path, minlength=len(model.langs)).argmax())
            mine = path == won
        # how sure: the winner's posterior in its words, times its share of all words
        part = scores[a:b][mine].sum(0)
        odds = np.exp(np.minimum(part - part[won], 0.0))
        langs.append(model.langs[won])
        shares.append(float(mine.mean() / odds.sum()))
        spans.append(",".join(f"{model.langs[k]}:{x}:{y}" for x, y, k in runs))
    return langs, shares, spans, gains


def spoken(model: Model, texts: pa.Array, gains: np.ndarray) -> np.ndarray:
    """Whether each text, with its gain by judge(), is in a learned language: see LEAST_GAIN."""
    data, at = utf8(texts)
    script = scripts_of(data)
    sums = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[at])
    ours, others = sums((script > 0) & model.learned[script]), sums((script > 0) & ~model.learned[script])
    letters, solid = sums(script > 0), sums(data > 32)
    return (gains >= LEAST_GAIN) & (letters >= LEAST_LETTERS * solid) & (ours > 0) & (ours >= others)


def _sent(docs: DataFrame, model: Model):
    """The model for all tasks: CELLS floats for each language, the one thing its size depends on."""
    return docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))


def _predict(blob, switch: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = pickle.loads(blob.value)
        for batch in pieces(batches):
            langs, scores, spans = predict(model, batch.column("text"), switch)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang_pred": langs, "score": pa.array(scores, pa.float64()), "spans": spans})

    return run


def identify(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """docs (doc_id, text, any more) -> lang_pred, score (0 to 1) and spans `lang:first word:end` of each text.

    Words are runs of letters and their marks; a word's script, by Unicode's ranges, leaves as candidates the
    languages learned in it. Texts that are null or have no letter are `und` with score 0, as are all if
    nothing was learned. Of languages that score alike the first by name wins; equal rows give equal rows,
    null doc_ids stay null, other columns are never read, an empty table gives an empty one. A plain map
    over the scan; the model is broadcast (CELLS floats for each language).
    """
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_predict(_sent(docs, model), switch), SCHEMA)


def held_out():
    """Whether a document is kept out of learning: crc32 of doc_id's digits leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_held_out(docs: DataFrame) -> DataFrame:
    """Learn from the labelled documents that are not held out, and predict all."""
    model = learn(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "spans")


def keep_identified(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """docs without those in which no learned language is found; a null lang becomes the one found.

    These are null texts, texts without letters or with few, texts mostly in a script that nothing was
    learned in, and those whose trigrams are no likelier in any learned language than by chance. A text in
    an unknown language stays if its trigrams are those of a learned one. Equal rows fare alike, null
    doc_ids stay null, further columns may have any name, an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    blob = _sent(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Model = pickle.loads(blob.value)
        for batch in pieces(batches):
            found, _, _, gains = judge(known, batch.column("text"), switch)
            at = batch.schema.get_field_index("lang")
            filled = pa.array([a if a is not None else b for a, b in zip(batch.column(at).to_pylist(), found)], batch.schema.field(at).type)
            rows = pa.RecordBatch.from_arrays([filled if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)
            keep = spoken(known, batch.column("text"), gains) & (np.array(found) != UNKNOWN)
            yield rows.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
