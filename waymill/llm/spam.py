"""Keyword-stuffed and link-list pages by robust Mahalanobis distance.

A first pass over all texts learns the function words of every language named in `lang`: words that stand in lower case
between two other words of a sentence, in at least FW_SHARE of the language's documents, and there rather than at its
ends. A language with fewer than LANG_DOCS documents has no words of its own.

A page is cut into stretches (sentences, or lines where there are none), and each stretch is measured: share of
function words, length, repetition of its words within the page, unevenness (how few different content words it
holds), density of links, tags, product codes and list marks, and, apart, density of facts (clock times, field syntax)
and sentence form. For each language, centre and scatter of the measures are robust ones over all stretches of the
corpus: medians, median absolute deviations, and a covariance from the deviations of sums and differences of pairs,
made positive definite. Sentences are the mass everywhere, so a stretch far away isn't a sentence; it counts as spam
only if it lies away in a spam-directed direction: fewer function words, more repetition, less entropy, more links,
tags or codes, and not towards facts and sentences. A page is spam when more than half of its words stand in such
stretches.

A stretch belongs to the language whose function words make up at least KNOWN of its words. One that belongs to none
but has the form of a sentence is measured against the scatter of all stretches without the axis of function words
(class OTHER), so a page isn't spam for being in a language that the corpus hardly holds. One without that form is
measured as its page's language asks, or against the scatter of all stretches (class ANY) if the page has none.

Pages with null, empty or tiny text (below MIN_WORDS words) are no cases; very long texts are read whole, and a page's
cost is linear in its length. Words are numbered and measured in arrays, many pages at a time. Over the corpus only
counts by (language, word) and histograms by language are aggregated; the driver receives the function words, at most
FW_MOST a language, and histograms of a fixed number of bins. Names of languages are two or three letters.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymill.session import BROADCAST_ROWS, Scratch

MEASURES = ("fw", "shape", "rep", "flat", "dens")
MIN_WORDS, FAR, LEAN = 12, 2.3, 4.0
#: Least scale of each measure: below it a deviation says nothing.
FLOOR = {"fw": 0.08, "shape": 0.35, "rep": 0.15, "flat": 0.08, "dens": 0.10}
#: Function words: least share of a language's documents, least share of those in which it stands inside a sentence,
#: most of them a language, and documents a language needs.
FW_SHARE, FW_INSIDE, FW_MOST, LANG_DOCS = 0.25, 0.5, 300, 30
#: Share of function words from which a stretch is known to be in a language, and from which one without the form of a
#: sentence or a whole page is; names of the classes of stretches in no language.
KNOWN, HINTED, OTHER, ANY = 0.25, 0.15, "", "*"
#: Words of the texts looked at in one lot of arrays.
LOT = 300_000

_INVISIBLE = re.compile("[\u200b-\u200d\u2060\ufeff\u00ad]")
_LINK = re.compile(r"<a\s[^>]*>(.*?)</a>|!?\[([^\]\n]*)\]\((?:https?://|www\.)[^)\s]*\)|(?:https?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}/\S+", re.I | re.S)
_TAG = re.compile(r"<[^<>]*>")
_BREAK = re.compile(r"<(?:br|/?p|/?li|/?div|/?h\d|/?tr|/?ul|/?ol)\b[^<>]*>", re.I)
_WORD = re.compile(r"[^\W_]+(?:['’][^\W\d_]+)?")
_SPLIT = re.compile(r"(?<=[.!?…])[\"'»”)]*\s+|(?<=[。！？])|[\r\n]+")
_HASH = re.compile(r"(?<!\S)#\w+")
_CODE = re.compile(r"[A-Z]{2}-?\d\d|\d[.,]\d\d\s?(?:[A-Z]{3}\b|[^\W\d_]{0,2}[€$£¥])|[€$£¥]\s?\d")
_DIGIT = re.compile(r"\d")
_MARKS = "/|~;,>*=•·"
_CLOCK = re.compile(r"\b\d?\d:\d\d\b")
_STOPS, _CLOSING = frozenset(".!?…。！？"), " \t\"'»”)]*_"
_END = re.compile(r"[.!?…。！？][\"'»”)\]*_]*\s*$")
_FIELD = re.compile(r"[\w.]+\s*[:=]\s*(?:[\"\d{\[]|\w+\.\w+)|[{}]")


def plain(text: str) -> tuple[list[str], list[int]]:
    """(stretches with links as marks, words of each link in order) of a text."""
    text = html.unescape(text) if "&" in text else text
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
    text = _BREAK.sub("\n", text) if "<" in text else text
    links: list[int] = []
    if "/" in text or "www." in text.lower():
        parts, at = [], 0  # links become a mark and keep their number of words
        for m in _LINK.finditer(text):
            inner = m.group(1) or m.group(2) or ""
            parts += [text[at : m.start()], " \u0001 "]
            links.append(len(_WORD.findall(_TAG.sub(" ", m.group(0)))) or 1)
            parts.append(f"\u0002{_TAG.sub(' ', inner)}\u0003" if inner else "")
            at = m.end()
        parts.append(text[at:])
        text = "".join(parts)
    text = _TAG.sub(" ", text) if "<" in text else text
    return [p for p in _SPLIT.split(text) if p and p.strip()], links


def words_of(piece: str) -> list[str]:
    return _WORD.findall(piece.lower()) if piece.isascii() else [w.lower() for w in _WORD.findall(piece)]


def named(lang) -> str:
    """The language a value of `lang` names: its first letters, '' for none."""
    code = re.match(r"[a-z]{2,3}(?![a-z])", lang.strip().lower()) if isinstance(lang, str) else None
    return "" if code is None or code[0] in ("und", "unk") else code[0]


def function_words(docs: DataFrame, scratch: Scratch) -> dict[str, frozenset[str]]:
    """Function words of every language, learned over all documents (doc_id, text, lang); a row that stands there several
    times counts once, its rows sharing its weight."""
    schema = "lang string, word string, inside double, n double"
    rows = docs.select("doc_id", "text", "lang").filter("doc_id IS NOT NULL AND text IS NOT NULL AND text <> '' AND lang IS NOT NULL")
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text", "lang"))
    repeated = scratch.write(rows.groupBy("row").agg(F.count(F.lit(1)).alias("times")).filter("times > 1"), "repeated")
    n = repeated.count()
    if n:
        rows = rows.join(F.broadcast(repeated) if n <= BROADCAST_ROWS else repeated, "row", "left")
    rows = rows.select("text", "lang", (F.lit(1.0) / F.coalesce("times", F.lit(1)) if n else F.lit(1.0)).alias("weight"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        inside: dict[str, Counter] = {}
        every: dict[str, Counter] = {}

        def out() -> pd.DataFrame:
            rows = [(lang, w, float(inside.get(lang, {}).get(w, 0)), float(n)) for lang, own in every.items() for w, n in own.items()]
            return pd.DataFrame(rows, columns=["lang", "word", "inside", "n"])

        for pdf in batches:
            for text, lang, weight in zip(pdf["text"], pdf["lang"], pdf["weight"], strict=True):
                if not (code := named(lang)):
                    continue
                own, some = set(), set()
                for p in _SPLIT.split(text):
                    if p.rstrip(_CLOSING)[-1:] in _STOPS:
                        own.update(_WORD.findall(p.lower()))
                        parts = p.split(" ")
                        some.update(b for a, b, c in zip(parts, parts[1:], parts[2:], strict=False) if b.isalpha() and b.islower() and a[-1:].isalnum() and c[:1].isalnum())
                if own:
                    own.add("")  # counts documents
                    for counts, found in ((every, own), (inside, some)):
                        counter = counts.setdefault(code, Counter())
                        counter.update(found if weight == 1 else dict.fromkeys(found, weight))
            if sum(map(len, every.values())) > 300_000:
                yield out()
                inside, every = {}, {}
        yield out()

    total = lambda c: F.round(F.sum(c), 6).alias(c)
    counts = scratch.write(rows.mapInPandas(run, schema).groupBy("lang", "word").agg(total("inside"), total("n")), "words")
    # a word in FW_SHARE of the documents is in a language's documents LANG_DOCS * FW_SHARE times at least
    counts = counts.filter((F.col("n") >= LANG_DOCS * FW_SHARE) & ((F.col("word") == "") | (F.col("inside") >= FW_INSIDE * F.col("n"))))
    size = counts.filter((F.col("word") == "") & (F.col("n") >= LANG_DOCS)).select("lang", F.col("n").alias("docs"))
    own = counts.filter("word <> ''").join(F.broadcast(size), "lang").filter(F.col("inside") >= FW_SHARE * F.col("docs"))
    found: dict[str, list] = {}
    for r in own.select("lang", "word", "inside").collect():
        found.setdefault(r["lang"], []).append((-r["inside"], r["word"]))
    return {lang: frozenset(w for _, w in sorted(ws)[:FW_MOST]) for lang, ws in sorted(found.items())}


class Vocabulary:
    """Numbers of words, with the languages whose function words they are."""

    def __init__(self, known: dict[str, frozenset[str]], limit: int = 300_000):
        self.langs, self.limit = list(known), limit
        self.of_word: dict[str, list[int]] = {}
        for i, lang in enumerate(self.langs):
            for w in known[lang]:
                self.of_word.setdefault(w, []).append(i)
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.small, self.marks = [], []  # by number: short word or number; languages
        self.add(self.of_word)

    def add(self, new) -> None:
        for w in new:
            self.ids[w] = len(self.ids)
            self.small.append((len(w) <= 2) + 2 * w.isdigit())
            self.marks.append(self.of_word.get(w, ()))

    def numbers(self, tokens: list[str]) -> np.ndarray:
        if len(self.ids) > self.limit:
            self.clear()
        self.add(set(tokens).difference(self.ids))
        return np.fromiter(map(self.ids.__getitem__, tokens), np.int64, len(tokens))

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """(small, a row of flags for every language) by number; function words come first."""
        flags = np.zeros((len(self.langs) + 1, len(self.ids)), bool)
        for k in range(len(self.of_word)):
            for i in self.marks[k]:
                flags[i, k] = True
        small = np.array(self.small, np.int8)
        flags[-1] = small & 1  # in an unknown language short words count as function words
        return small, flags


def _counts(at: np.ndarray, size: int, weights=None) -> np.ndarray:
    return np.bincount(at, weights, size)


def _times(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each key stands there, and whether it is the first of its kind."""
    _, first, inverse, n = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    once = np.zeros(len(keys), bool)
    once[first] = True
    return n[inverse], once


def measured_lot(pages: list[tuple[list[str], list[int]]], vocabulary: Vocabulary) -> pd.DataFrame:
    """One row (page, part, lang, n, n_link, *measures, facts) for each stretch of pages given as plain() gives them."""
    pieces = [p for own, _ in pages for p in own]
    total, n_pages, n_langs = len(pieces), len(pages), len(vocabulary.langs)
    page = np.repeat(np.arange(n_pages), [len(own) for own, _ in pages])
    tokens = [words_of(p) for p in pieces]
    n = np.fromiter(map(len, tokens), np.int64, total)
    ids = vocabulary.numbers(list(chain.from_iterable(tokens)))
    small, flags = vocabulary.arrays()
    at = np.repeat(np.arange(total), n)  # stretch of each word
    some = np.maximum(n, 1)
    form = np.fromiter((5 <= k <= 80 and _END.search(p) is not None for k, p in zip(n.tolist(), pieces, strict=True)), bool, total)
    # language of each stretch, else of its page
    lang, share, of_page, most = np.full(total, -1), np.zeros(total), np.full(n_pages, -1), np.zeros(n_pages)
    words = np.maximum(_counts(page, n_pages, n), 1)
    shares = np.zeros((n_langs + 1, total))
    for i in range(n_langs):
        hits = _counts(at, total, flags[i][ids])
        shares[i] = hits / some
        own = (shares[i] >= np.where(form, KNOWN, HINTED)) & (hits >= 2) & (shares[i] > share)
        lang[own], share[own] = i, shares[i][own]
        whole = _counts(page, n_pages, hits) / words
        holds = (_counts(page, n_pages, own) > 0) & (whole >= HINTED) & (whole > most)
        of_page[holds], most[holds] = i, whole[holds]
    lang = np.where((lang < 0) & ~form, of_page[page], lang)
    share = shares[lang, np.arange(total)]
    lang = np.where(lang >= 0, lang, np.where(form, n_langs, n_langs + 1))
    # content words: neither numbers nor function words of the page's language
    page_at = page[at]
    content = ~flags[of_page[page_at], ids] & (small[ids] < 2)
    c_at, c_id, c_page = at[content], ids[content], page_at[content]
    width = len(small)
    times, _ = _times(c_page * width + c_id)
    # repetition: content words that the page holds again and again beyond what its length explains, and repeated pairs
    often = np.maximum(2.0, 0.012 * _counts(c_page, n_pages))
    rep = _counts(c_at, total, times > often[c_page]) / some
    where = np.flatnonzero(content[:-1] & content[1:] & (at[:-1] == at[1:])) if len(at) else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        pair = (ids[where] * np.int64(1_000_003) + ids[where + 1]) * np.int64(2_654_435_761) + page_at[where] * np.int64(40_503_000_017)
    twice, _ = _times(pair)
    again = _counts(at[where], total, twice > 1) / np.maximum(n - 1, 1)
    _, once = _times(c_at * width + c_id)
    n_content, different = _counts(c_at, total), _counts(c_at, total, once)
    flat = np.where(n_content > 3, 1 - different / np.maximum(n_content, 1), 0.0)
    # what needs the text itself
    n_link, dens, facts = np.zeros(total, np.int64), np.zeros(total), np.zeros(total)
    i = 0
    for own, links in pages:
        used = 0
        for p in own:
            size = some[i]
            d = 0.0
            if links and (marks := p.count("\u0001")):
                n_link[i] = sum(links[used : used + marks])
                used += marks
                d += marks / (n[i] / 3 + marks)
            if "#" in p:
                d += len(_HASH.findall(p)) / size
            d += max(0.0, sum(map(p.count, _MARKS)) / size - 0.15)
            if _DIGIT.search(p):
                d += 2 * len(_CODE.findall(p)) / size
            dens[i] = min(1.0, d)
            if ":" in p or "=" in p or "{" in p or "}" in p:
                facts[i] = min(1.0, (2 * len(_CLOCK.findall(p)) + 2 * len(_FIELD.findall(p))) / size)
            if form[i]:
                facts[i] = min(1.0, facts[i] + 0.1)
            i += 1
    # a stretch of links alone is as long as its links
    shape = np.abs(np.log(np.maximum(np.where(n > 0, n, n_link), 1) / 10))
    names = np.array([*vocabulary.langs, OTHER, ANY], object)
    part = np.arange(total) - np.repeat(np.cumsum([len(own) for own, _ in pages]) - [len(own) for own, _ in pages], [len(own) for own, _ in pages]) if total else np.zeros(0, np.int64)
    return pd.DataFrame({"page": page, "part": part, "lang": names[lang], "n": n, "n_link": n_link, "fw": share, "shape": shape, "rep": np.maximum(rep, again), "flat": flat, "dens": dens, "facts": facts})


_SCHEMA = "doc_id bigint, key bigint, part int, lang string, n int, n_link int, " + ", ".join(f"{m} float" for m in MEASURES) + ", facts float"


def measured(docs: DataFrame, known: dict[str, frozenset[str]]) -> DataFrame:
    """One row for each stretch of each page."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary(sent.value)
        docs, keys, lot, size = [], [], [], 0

        def out() -> pd.DataFrame:
            rows = measured_lot(lot, vocabulary)
            rows["doc_id"], rows["key"] = np.array(docs, np.int64)[rows["page"]], np.array(keys, np.int64)[rows["page"]]
            return rows.drop(columns="page")[[f.split()[0] for f in _SCHEMA.split(", ")]]

        for pdf in batches:
            for doc, key, text in zip(pdf["doc_id"], pdf["key"], pdf["text"], strict=True):
                docs.append(doc)
                keys.append(key)
                lot.append(plain(text))
                size += len(text) // 6
                if size > LOT:
                    yield out()
                    docs, keys, lot, size = [], [], [], 0
        if lot:
            yield out()

    own = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    return own.filter("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''").mapInPandas(run, _SCHEMA)


#: Bins of the histograms from which quantiles are read: so many to a unit, values above the last one fall in it.
BINS, TOP = 1000, 12


def _histograms(rows: DataFrame, values) -> dict[tuple[str, str], np.ndarray]:
    """Histograms by (language, name) of what values(language, measures) gives for a batch: name -> array; the class
    ANY holds those of all rows.

    Every task sums its own rows and hands over one histogram a language and name; all of them are added up.
    """
    schema = "lang string, name string, bin int, n bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[tuple[str, str], np.ndarray] = {}
        for pdf in batches:
            groups = [(lang, g) for lang, g in pdf.groupby("lang") if lang not in (OTHER, ANY)]
            for lang, g in [*groups, (ANY, pdf)]:
                for name, v in values(lang, g[list(MEASURES)].to_numpy(float)).items():
                    bins = np.minimum(v * BINS, BINS * TOP - 1).astype(np.int64)
                    own[lang, name] = own.get((lang, name), 0) + np.bincount(bins, minlength=BINS * TOP)
        for (lang, name), h in own.items():
            at = np.flatnonzero(h)
            yield pd.DataFrame({"lang": lang, "name": name, "bin": at, "n": h[at]})

    parts = rows.select("lang", *MEASURES).mapInPandas(run, schema)
    out: dict[tuple[str, str], np.ndarray] = {}
    for r in parts.groupBy("lang", "name", "bin").agg(F.sum("n").alias("n")).collect():
        out.setdefault((r["lang"], r["name"]), np.zeros(BINS * TOP, np.int64))[r["bin"]] = r["n"]
    return out


def _median(h: np.ndarray) -> float:
    """The lower median, to a bin's width."""
    return int(np.searchsorted(np.cumsum(h), (h.sum() + 1) // 2)) / BINS


def robust_frames(rows: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """(centre, inverse scatter) of the measures by language, from histograms over all stretches."""
    plain_ = _histograms(rows, lambda lang, x: {m: x[:, i] for i, m in enumerate(MEASURES)})
    langs = sorted({lang for lang, _ in plain_})
    centre = {g: np.array([_median(plain_[g, m]) for m in MEASURES]) for g in langs}
    k, floor = len(MEASURES), np.array([FLOOR[m] for m in MEASURES])

    def spread(lang: str, x: np.ndarray) -> dict[str, np.ndarray]:
        u = (x - centre[lang]) / floor
        one = {f"d{i}": np.abs(u[:, i]) for i in range(k)}
        return one | {f"{c}{i}{j}": np.abs(u[:, i] + s * u[:, j]) for i in range(k) for j in range(i) for c, s in (("p", 1), ("m", -1))}

    wide = _histograms(rows, spread)
    out = {}
    for g in langs:
        d = {name: _median(h) for (lang, name), h in wide.items() if lang == g}
        scale = np.maximum(1.4826 * np.array([d[f"d{i}"] for i in range(k)]), 1.0)
        cov = np.diag(scale**2)
        for i in range(k):
            for j in range(i):
                c = 1.4826**2 * (d[f"p{i}{j}"] ** 2 - d[f"m{i}{j}"] ** 2) / 4
                most = 0.5 * scale[i] * scale[j]
                cov[i, j] = cov[j, i] = np.clip(c, -most, most)
        val, vec = np.linalg.eigh(cov)
        cov = vec @ np.diag(np.maximum(val, 0.25)) @ vec.T
        unit = np.diag(1 / floor)
        out[g] = (centre[g], unit @ np.linalg.inv(cov) @ unit)
        if g == ANY:  # without the axis of function words
            axes = [i for i, m in enumerate(MEASURES) if m != "fw"]
            inverse = np.zeros((k, k))
            inverse[np.ix_(axes, axes)] = np.linalg.inv(cov[np.ix_(axes, axes)])
            out[OTHER] = (centre[g], unit @ inverse @ unit)
    return out


#: What a stretch made of facts alone loses on its way towards spam.
FACTS = 25.0
#: Direction of spam in units of FLOOR; `shape` has none of its own.
DIRECTION = {"fw": -1.0, "shape": 0.0, "rep": 1.0, "flat": 1.0, "dens": 1.0}


def scored(rows: DataFrame, frames: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """rows with `distance`, the lean towards spam, and whether the stretch counts as spam."""
    per = lambda values: F.create_map(*[x for lang, v in values.items() for x in (F.lit(lang), F.array(*[F.lit(float(y)) for y in v]))])[F.col("lang")]
    mid, inv = per({g: c for g, (c, _) in frames.items()}), per({g: m.ravel() for g, (_, m) in frames.items()})
    k = len(MEASURES)
    z = [F.col(m) - mid[i] for i, m in enumerate(MEASURES)]
    d2 = sum((inv[i * k + j] * z[i] * z[j] for i in range(k) for j in range(k)), F.lit(0.0))
    way = lambda m: F.when(F.col("lang") == OTHER, 0.0).otherwise(DIRECTION[m]) if m == "fw" else F.lit(DIRECTION[m])
    lean = sum((way(m) / FLOOR[m] * z[i] for i, m in enumerate(MEASURES)), F.lit(0.0)) - FACTS * F.col("facts")
    out = rows.withColumn("distance", F.sqrt(F.greatest(F.lit(0.0), d2))).withColumn("lean", lean)
    return out.withColumn("spam", (F.col("distance") > FAR) & (F.col("lean") > LEAN))


def spam_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, words, spam_words, other_words) of every page with at least MIN_WORDS words, one row for each text of a
    doc_id; other_words stand in stretches of no learned language."""
    scratch = Scratch(docs.sparkSession, "spam")
    rows = scratch.write(measured(docs, function_words(docs, scratch)), "stretches")
    frames = robust_frames(rows)
    none = F.lit(0).cast("bigint")
    if not frames:
        return rows.select("doc_id", none.alias("words"), none.alias("spam_words"), none.alias("other_words")).limit(0)
    s = scored(rows, frames)
    words = F.col("n") + F.col("n_link")
    copies = F.count_if(F.col("part") == 0)  # a row that stands there twice doubles its sums
    pages = s.groupBy("doc_id", "key").agg(
        F.sum(words).alias("w"), F.sum(F.when(F.col("spam"), words).otherwise(0)).alias("b"), F.sum(F.when(F.col("lang") == OTHER, words).otherwise(0)).alias("o"), copies.alias("c")
    )
    each = lambda c, name: (F.col(c) / F.col("c")).cast("bigint").alias(name)
    return pages.select("doc_id", each("w", "words"), each("b", "spam_words"), each("o", "other_words")).filter(F.col("words") >= MIN_WORDS)
