"""Languages of documents and of the stretches of mixed ones, by a byte convolutional network over fixed-length windows."""

from __future__ import annotations

import copy
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm.byte_cnn import WINDOW, ByteCNN, stack, windows
from evalloom.llm.common import spread_small
from evalloom.session import read_bytes, shared_dir, ship_package, write_bytes

#: Names and codes of the ten languages, squashed and without accents. Fixed values.
LANGUAGE_NAMES = {
    "en": ["en", "eng", "english", "englisch", "anglais", "ingles"],
    "de": ["de", "deu", "ger", "german", "deutsch", "allemand", "aleman"],
    "fr": ["fr", "fra", "fre", "french", "francais", "franzosisch", "frances"],
    "es": ["es", "spa", "esp", "spanish", "espanol", "castellano", "castilian", "spanisch"],
    "it": ["it", "ita", "italian", "italiano", "italienisch"],
    "pt": ["pt", "por", "portuguese", "portugues", "portugiesisch"],
    "nl": ["nl", "nld", "dut", "dutch", "nederlands", "niederlandisch", "flemish", "vlaams"],
    "pl": ["pl", "pol", "polish", "polski", "polnisch"],
    "ru": ["ru", "rus", "russian", "russkij", "russkiy", "русский", "russisch"],
    "zh": ["zh", "zho", "chi", "cmn", "chinese", "mandarin", "中文", "汉语", "chinesisch"],
}

#: Quotations and insertions of fewer words are no part of any stretch; neither is a run of fewer words.
LEAST_WORDS = 8
SWITCH = 3.0  # log-odds that a change of language must bring
FLOOR = -7.0
STEPS = (300, 500)  # of a first fit and of one that goes on from another
VERSION = 2  # of the network and its training; saved weights of another are not read
HAN_WORD = 0.6  # words that a Han character counts for

# The lookaheads spare the alternatives a try at every character.
SENTENCE = re.compile(r"(?=[.!?…。！？\n])(?:(?<![.!?…])[.!?…]++[\"'»”’)\]]*(?=\s)|[。！？]+[”’」』）]*|\n+)\s*")
BRACKETS = re.compile(r"(?=[(\[{（«„“「\"'‘])(?:\([^()\n]*\)|\[[^\[\]\n]*\]|\{[^{}\n]*\}|（[^（）\n]*）|«[^«»\n]*»|„[^„“”\n]*[“”]|“[^“”\n]*”|「[^「」\n]*」|\"[^\"\n]*\"|(?<!\w)'[^'\n]*'(?!\w)|(?<!\w)‘[^‘’\n]*’(?!\w))")
CODE_MARK = r"0-9_=|<>{}\\/@#$^~"
INK = re.compile(r"[^\s一-鿿，。、：；？！（）]++")  # what stands for a word where there are no blanks between words
CODE = re.compile(f"[{CODE_MARK}]")
PLAIN = re.compile(rf"(?<!\S)[^\s{CODE_MARK}]++(?!\S)")
CAMEL = re.compile(r"[a-zà-ÿ][A-Z]")
HAN = re.compile(r"[㐀-鿿]")
WORD = re.compile(r"[^\W\d_]+")
MOJIBAKE = re.compile("[\x80-\xffŒœŠšŸŽžƒˆ˜–—‘-„†-•…‰‹›€™]{2,}")


def _redecode(match: re.Match) -> str:
    run = match.group()
    try:
        return b"".join(ch.encode("cp1252") if ord(ch) > 255 or not 0x80 <= ord(ch) < 0xA0 else bytes([ord(ch)]) for ch in run).decode("utf-8")
    except (UnicodeEncodeError, UnicodeDecodeError):
        return run


def repaired(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The text with wrongly decoded runs decoded again, and pairs (place in it, place in ``text``) from which places run in step."""
    if text.isascii():
        return text, [(0, 0)]
    out, steps, last, size = [], [(0, 0)], 0, 0
    for m in MOJIBAKE.finditer(text):
        new = _redecode(m)
        if new != m.group():
            out += [text[last : m.start()], new]
            size += m.start() - last + len(new)
            last = m.end()
            steps.append((size, last))
    return "".join([*out, text[last:]]), steps


def word_count(text: str) -> float:
    han = 0 if text.isascii() else len(HAN.findall(text))
    return han * HAN_WORD + len(WORD.findall(HAN.sub(" ", text) if han else text))


def units(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, cleaned text, words): sentences and long quotations in reading order, without names, numbers, code and short quotations.

    Text that was decoded wrongly is decoded again first; the places refer to the text as it is stored.
    """
    text, steps = repaired(text)
    pieces, last, cuts = [], 0, {0, len(text)}
    for m in BRACKETS.finditer(text):
        if word_count(m.group()) < LEAST_WORDS:
            pieces += [text[last : m.start()], " " * (m.end() - m.start())]
            last = m.end()
        else:
            cuts |= {m.start(), m.end()}
    masked = "".join([*pieces, text[last:]])
    cuts.update(m.end() for m in SENTENCE.finditer(masked))
    at = sorted(cuts)
    out = [(a, b, masked[a:b]) for a, b in zip(at, at[1:], strict=False)]
    cleaned = []
    for a, b, s in out:
        # Words with a digit or another mark of code, or with a capital inside, are names, numbers or code.
        if not s.isascii() and HAN.search(s):
            kept = INK.sub(lambda m: " " if CODE.search(m.group()) else m.group(), s).split()
        else:
            kept = PLAIN.findall(s)
            if CAMEL.search(s):
                kept = [w for w in kept if not CAMEL.search(w)]
        s = " ".join(kept).lower()
        n = word_count(s)
        if n >= 1:
            cleaned.append((a, b, s, n))
    if len(steps) > 1:
        news = [x[0] for x in steps]

        def stored(p: int) -> int:
            new, old = steps[bisect_right(news, p) - 1]
            return old + p - new

        cleaned = [(stored(a), stored(b), s, n) for a, b, s, n in cleaned]
    return cleaned


def decode(scores: np.ndarray, words: list[float]) -> list[int]:
    """The most likely label of each unit if every change costs SWITCH; short units weigh less."""
    top = scores.argmax(axis=1)
    if (top == top[0]).all():
        return [int(top[0])] * len(top)
    e = np.maximum(scores, FLOOR) * np.minimum(1.0, np.asarray(words) / LEAST_WORDS)[:, None]
    best, back = e[0], []
    for row in e[1:]:
        top = int(best.argmax())
        stay = best >= best[top] - SWITCH
        back.append(np.where(stay, np.arange(len(row)), top))
        best = np.where(stay, best, best[top] - SWITCH) + row
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def stretches(found: list[tuple[int, int, str, float]], scores: np.ndarray) -> list[tuple[int, int, int, float, float]]:
    """(start, end, label, confidence, words) of the runs of one language; runs under LEAST_WORDS words neither are one nor end one."""
    if not found:
        return []
    words = [u[3] for u in found]
    path = decode(scores, words)
    keep = list(range(len(found)))
    while True:
        runs: list[list[int]] = []
        for i in keep:
            if runs and path[runs[-1][-1]] == path[i]:
                runs[-1].append(i)
            else:
                runs.append([i])
        short = [r for r in runs if sum(words[i] for i in r) < LEAST_WORDS]
        if not short or len(runs) == 1:
            break
        drop = set(min(short, key=lambda r: sum(words[i] for i in r)))
        keep = [i for i in keep if i not in drop]
    out = []
    for r in runs:
        w = np.array([words[i] for i in r])
        label = path[r[0]]
        out.append((found[r[0]][0], found[r[-1]][1], label, float((np.exp(scores[r, label]) * w).sum() / w.sum()), float(w.sum())))
    return out


def classify(texts: list[str | None], model: ByteCNN) -> list[list[tuple[int, int, int, float, float]]]:
    """Stretches of each text. Windows of all units are put through the network in batches; a unit's score is the mean of its windows.

    Units of the same cleaned text, as boilerplate lines are, have the same windows and so are scored once.
    """
    parsed = [units(t) if t else [] for t in texts]
    number: dict[str, int] = {}
    places = [[number.setdefault(u[2], len(number)) for u in doc] for doc in parsed]
    parts: list[bytes] = []
    counts: list[int] = []
    for text in number:
        w = windows(text.encode("utf-8"))
        parts += w
        counts.append(len(w))
    if not parts:
        return [[] for _ in texts]
    logs = model.log_probabilities(stack(parts))
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    means = np.add.reduceat(logs, starts, axis=0) / np.asarray(counts)[:, None]
    means -= np.log(np.exp(means).sum(axis=1, keepdims=True))
    return [stretches(doc, means[at]) if doc else [] for doc, at in zip(parsed, places, strict=True)]


_fitted: dict = {}


def fitted(spark: SparkSession, rows: list[tuple[str, str]], seed: int = 0, start: ByteCNN | None = None) -> ByteCNN:
    """A network fitted on ``rows`` (text, language), going on from ``start`` if given.

    The weights are kept in this process and, as a file of some 30 kB, in the shared folder, under a name made of all that they depend on; so a later run over the same
    rows, in whatever process, reads them instead of fitting again.
    """
    if not rows:
        raise ValueError("no labelled text to learn from")
    mark = hashlib.sha256(repr((VERSION, seed, sorted(rows))).encode())
    mark.update(start.to_bytes() if start else b"")
    key = mark.hexdigest()[:32]
    if key not in _fitted:
        path = f"{shared_dir(spark)}/evalloom-models/{key}.npz"
        data = read_bytes(spark, path)
        if data is None:
            network = copy.deepcopy(start) if start else ByteCNN(sorted({r[1] for r in rows}), seed)
            network.fit([r[0] for r in sorted(rows)], [r[1] for r in sorted(rows)], steps=STEPS[start is not None], seed=seed)
            write_bytes(spark, path, network.to_bytes())
            _fitted[key] = network
        else:
            _fitted[key] = ByteCNN.from_bytes(data)
    return _fitted[key]


def fit_on_samples(samples: DataFrame, text: str, lang: str, most: int = 20_000, seed: int = 0) -> tuple[ByteCNN, list[tuple[str, str]]]:
    """A network fitted on labelled sentences, at most ``most`` of them (those of the smallest hashes), and the rows it was fitted on."""
    rows = samples.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(text, lang).distinct().orderBy(F.xxhash64(text, lang)).limit(most).collect()
    listed = [(r[0], r[1]) for r in rows]
    return fitted(samples.sparkSession, listed, seed), listed


def fit_on_documents(samples: DataFrame, sample_text: str, sample_lang: str, docs: DataFrame, ident: str, text: str, label: Column, most: int = 2000, pieces: int = 20_000, seed: int = 0) -> ByteCNN:
    """A network fitted on clean samples and then further on them together with labelled documents.

    Of the documents with a label that names a language, the ``most`` of the smallest hashes of their id are judged, as whole texts and on the executors, by a
    first network fitted on the samples alone. Those in which it finds one stretch only, of the language of the label, give their sentences, cut to
    pieces of a window's length, of which ``pieces`` at most (those of the smallest hashes) come to the driver and into the second fit, which goes on from the first. So
    wrong labels do not teach. ``most`` and ``pieces`` bound the training set only; everything is classified whole.
    """
    spark = docs.sparkSession
    first, rows = fit_on_samples(samples, sample_text, sample_lang, seed=seed)
    ship_package(spark)
    labels = first.labels

    def teach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t, right, found in zip(pdf["t"], pdf["l"], classify(pdf["t"].tolist(), first), strict=True):
                if len(found) == 1 and labels[found[0][2]] == right:
                    out += [(u[2][i : i + WINDOW], right) for u in units(t) if u[3] >= LEAST_WORDS / 2 for i in range(0, len(u[2]), WINDOW)]
            yield pd.DataFrame(out, columns=["piece", "lang"])

    chosen = docs.where(F.col(text).isNotNull() & label.isNotNull()).select(F.col(text).alias("t"), label.alias("l"), F.xxhash64(F.col(ident)).alias("h"))
    chosen = spread_small(chosen.orderBy("h", F.xxhash64("t")).limit(most)).select("t", "l")
    more = chosen.mapInPandas(teach, "piece string, lang string").distinct().orderBy(F.xxhash64("piece", "lang")).limit(pieces).collect()
    return fitted(spark, rows + [(r[0], r[1]) for r in more], seed, first) if more else first


def label_language(label: Column) -> Column:
    """The two-letter code of the first word of a label that names one of the languages, as a code or in words; null where none does."""
    plain = F.translate(F.lower(label), "áàâäãåéèêëíìîïóòôöõúùûüçñ", "aaaaaaeeeeiiiiooooouuuucn")

    def code(word: Column) -> Column:
        out = F.lit(None).cast("string")
        for c, names in LANGUAGE_NAMES.items():
            out = F.when(word.isin(*names), c).otherwise(out)
        return out

    return F.get(F.filter(F.transform(F.split(plain, r"[^\p{L}\p{M}]+"), code), lambda x: x.isNotNull()), F.lit(0))


STRETCHES = "stretches array<struct<start:int,end:int,lang:string,confidence:double,words:double>>"


def slices(texts: list[str | None], characters: int) -> Iterator[list[str | None]]:
    """Runs of texts of about ``characters`` characters together, at least one text each."""
    run: list[str | None] = []
    size = 0
    for t in texts:
        n = len(t) if t else 0
        if run and size + n > characters:
            yield run
            run, size = [], 0
        run.append(t)
        size += n
    if run:
        yield run


def language_stretches(docs: DataFrame, ident: str, text: str, model: ByteCNN, keep: list[str] | None = None, characters: int = 4_000_000) -> DataFrame:
    """(ident, kept columns, stretches): the stretches of each text in reading order; an empty array for a null, empty or wordless text.

    Rows are treated one by one, so repeated ones have equal results; a null ident is kept. start and end are places in the text as stored. One pass
    over the rows in their partitions, whole texts, about ``characters`` characters scored at a time.
    """
    keep = keep or []
    ship_package(docs.sparkSession)
    slim = spread_small(docs.select(ident, *keep, text))
    labels = model.labels

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for part in slices([t if isinstance(t, str) else None for t in pdf[text].tolist()], characters):
                for doc in classify(part, model):
                    out.append([{"start": a, "end": b, "lang": labels[k], "confidence": c, "words": w} for a, b, k, c, w in doc])
            yield pdf[[ident, *keep]].assign(stretches=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields if f.name != text)
    return slim.mapInPandas(run, f"{schema}, {STRETCHES}")
