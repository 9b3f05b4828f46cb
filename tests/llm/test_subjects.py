"""Subjects: a small made corpus with known subjects, held-out accuracy, and the special cases."""

from __future__ import annotations

import html
import random
import re

import numpy as np
from hypothesis import given, settings, strategies as st

from parlance.llm import subjects as S

WORDS = {
    "sea": "harbour anchor sail mast tide rudder keel gull reef captain deck cargo".split(),
    "bread": "flour dough yeast oven crust knead loaf rye butter baker crumb salt".split(),
    "sky": "comet orbit star eclipse moon planet lens nova cloud zenith meteor dawn".split(),
}
FRAME = "Nobody at the table had expected the {} and then the {}."
FILLER = ["door", "lamp", "stair", "chair", "window", "candle"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        own = rng.sample(sorted(WORDS), rng.choice([0, 1, 1, 1, 2]))
        parts = [FRAME.format(*(rng.choice(WORDS[s]) for _ in range(2))) for s in own for _ in range(rng.randint(4, 6))]
        parts += [FRAME.format(*(rng.choice(FILLER) for _ in range(2))) for _ in range(rng.randint(1, 3))]
        rng.shuffle(parts)
        docs.append((i, " ".join(parts), "en"))
        truth[i] = set(own)
    return docs, truth


SENTENCE = re.compile(r"""(?<=[.!?…])["'”’»)\]}]*\s+|\s*\n\s*""")


def sentences(text):
    """The plain way: split, then find the words."""
    found = (re.findall(r"[^\W\d_]+", s) for s in SENTENCE.split(html.unescape(text).lower()))
    return [s for s in found if s]


@settings(max_examples=300)
@given(st.text(st.sampled_from("ab é.!?…\"')\n\t\xa0 1_-&"), max_size=80))
def test_tokens_make_the_plain_sentences(text):
    known, found = S.Pieces(), [[]]
    every, _ = known.expand(np.array([known[p] for p in S.pieces(text)], dtype=np.int64))
    for n in every.tolist():
        if n == S.END:
            found.append([])
        else:
            found[-1].append(n)
    assert [f for f in found if f] == [[S._IDS[w] for w in one] for one in sentences(text)]


def test_languages():
    texts = ("the cat and the dog", "die Katze und der Hund ist am Tor", "el gato y la casa que fue del rey", "xyzzy")
    words = [[S._IDS[w] for p in sentences(t) for w in p] for t in texts]
    starts = np.cumsum([0, *map(len, words)])[:-1]
    assert [S.LANGUAGES[i] for i in S.languages(np.array(sum(words, []), dtype=np.uint32), starts)] == ["en", "de", "es", "en"]


def test_terms_are_the_plain_ones(spark):
    docs = [(1, "The red door. The door of red stone!"), (2, "Nothing; red door\nred door"), (3, "the"), (4, "... 12 !")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    batch = S._parse(df.coalesce(1)).toArrow().to_batches()[0]
    w = S.Words.of(batch)
    assert w.doc.tolist() == [0, 0, 1, 1, 2]
    frame = {"the", "of"}
    sentence, place = w.terms(np.array(sorted(S._IDS[x] for x in frame), dtype=np.int64))
    plain = []
    for n, words in enumerate(p for _, t in docs for p in sentences(t)):
        kept = [x for x in words if x not in frame]
        plain += [(n, x) for x in {*kept, *zip(kept, kept[1:])}]
    # As many distinct terms in each sentence, and the same place exactly where the term is the same.
    assert np.bincount(sentence, minlength=5).tolist() == np.bincount([n for n, _ in plain], minlength=5).tolist()
    assert len(set(place.tolist())) == len({x for _, x in plain})


def test_accuracy_and_special_rows(spark):
    docs, truth = corpus(400)
    labels = [(i, s) for i in range(60) for s in (truth[i] or {"none"})]
    extra = [(1000, None, "en"), (1001, "", "en"), (1002, "123 !!", "en"), (None, "the sea", "en"), (1003, docs[0][1], None), (1004, docs[1][1] * 200, "en")]
    df = spark.createDataFrame(docs + extra, "doc_id long, text string, share string")
    areas = spark.createDataFrame([(s, 1) for s in (*WORDS, None)], "subject string, lang int")
    got: dict = {}
    for r in S.subject_areas(df, spark.createDataFrame(labels, "doc_id long, subject string"), areas).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(got.get(i, set()) == truth[i] for i in range(60, 400))
    assert right / 340 >= 0.9
    assert not {1000, 1001, 1002, None} & set(got)
    assert got.get(1003, set()) == got.get(0, set()) and got.get(1004, set()) == got.get(1, set())


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels, areas = spark.createDataFrame([], "doc_id long, subject string"), spark.createDataFrame([("sea",)], "subject string")
    assert S.subject_areas(docs, labels, areas).count() == 0
    some = spark.createDataFrame(corpus(30)[0], "doc_id long, text string, lang string")
    assert S.subject_areas(some, labels, areas).count() == 0
    assert S.subject_areas(some, labels, areas.limit(0)).count() == 0
