import random
import zlib

from millrace.llm import registry, toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automata_find_what_edit_distance_finds():
    rng = random.Random(2)
    word = lambda k: "".join(rng.choices("abc", k=k))
    for _ in range(20):
        terms = {word(rng.randint(3, 11)): 1.0 for _ in range(8)}
        automaton = toxicity.TrieAutomaton(toxicity.Lexicon(terms))
        for _ in range(150):
            w = word(rng.randint(1, 12))
            near = [(distance(w, t), t) for t in terms if distance(w, t) <= toxicity.edits_for(t)]
            found = automaton.find(w)
            assert (found is None) == (not near)
            if near:
                assert found == (min(near)[1], min(near)[0])


def test_windows_tell_quotes_company_and_context():
    lexicon = toxicity.Lexicon({"idiot": 4.0, "scum": 3.0}, {}, {"idiot": 3.0}, {"report": -2.0})
    matches = toxicity.Matches(lexicon)

    def hits(text):
        return toxicity.in_windows(text, *toxicity.hits_of(text, matches), lexicon)

    assert [h.weight for h in hits("such an idiott")] == [3.0] and hits("nothing here") == []
    assert not hits("you are an idiot")[0].quoted and hits('he said "idiot" there')[0].quoted
    assert [h.others for h in hits("idiot and scum " + "x " * 20 + "scum")] == [1, 1, 0]
    assert "report" in hits("a report of idiot things")[0].near
    assert toxicity.features("a report of idiot things", matches, lexicon)[5] == -2.0


def test_reported_quotes_are_learned_from_labels(spark):
    """The same insult, quoted in reports that are labelled harmless and said plainly in texts that are not."""
    rng = random.Random(4)
    filler = lambda: " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "omega"], k=6))
    rows = []
    for i in range(240):
        if i % 3 == 0:
            rows.append((f"{filler()} you are a moronic fool {filler()}", 1))
        elif i % 30 == 1:
            rows.append((f'{filler()} the minutes record that someone wrote "moronic" {filler()}', 0))
        else:
            rows.append((filler(), 0))
    model = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"), least_odds=1.5)
    assert model.lexicon.context.get("minutes", 0) < -0.5 or model.weights[4] < 0 or model.weights[5] > 0
    docs = spark.createDataFrame([(1, "alpha you are a moronic fool beta"), (2, 'gamma the minutes record that someone wrote "moronic" beta alpha')], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert got[1] > 0.5 > got[2]


def plain_score(text, model):
    """The score with every word compared to every term and stem."""
    import math

    lexicon, words = model.lexicon, toxicity.WORD.findall((text or "").lower())
    found = []
    for i, w in enumerate(words):
        near = sorted((distance(w, t), t) for t in lexicon.terms if abs(len(w) - len(t)) <= 2 and distance(w, t) <= toxicity.edits_for(t))
        stem = max((s for s in lexicon.stems if w.startswith(s)), key=len, default=None)
        if near and near[0][0] == 0:
            found.append((i, near[0][1], 0))
        elif stem:
            found.append((i, stem, -1))
        elif near:
            found.append((i, near[0][1], near[0][0]))
    hits = [h for h in toxicity.in_windows(text or "", words, found, lexicon) if h.weight > 0]
    plain, quoted = [h.weight for h in hits if not h.quoted], [h.weight for h in hits if h.quoted]
    x = [1.0] + [0.0] * 6
    if hits:
        context = sum(max(-3.0, min(3.0, sum(lexicon.context.get(w, 0.0) for w in h.near))) for h in hits) / len(hits)
        x = [1.0, max(plain, default=0.0), math.log1p(sum(plain)), sum(plain) / (10 + len(words)), math.log1p(sum(quoted)), context, sum(h.others > 0 for h in hits) / len(hits)]
    z = sum(a * b for a, b in zip(x, model.weights, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_scores_equal_a_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(toxicity.training_rows(docs, labels))
    assert model is not None
    texts = {r.doc_id: r.text for r in docs.collect()}
    short = {i for i, t in texts.items() if len(t or "") < 1500}
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect() if r.doc_id in short}
    assert len(got) > 20 and all(abs(s - plain_score(texts[i], model)) < 1e-9 for i, s in got.items())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = registry.op7(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    tested = [(labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in tested) / len(tested) > 0.9


def test_awkward_texts_and_labels(spark):
    schema = "doc_id long, text string, score double"
    rows = [(i, "you worthless scum" if i % 3 == 0 else "plain words of no harm", 1.0) for i in range(60)]
    docs = spark.createDataFrame([*rows, (100, None, 0.0), (101, "", 0.0), (102, "word " * 100_000, 0.0), (100, "wortless scum!", 0.0), (None, "you worthles scum", 0.0)], schema)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(0, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.training_rows(docs, labels))
    got = [(r.doc_id, r.score) for r in toxicity.score(docs, model).collect()]
    assert len(got) == docs.count()
    bad = [s for i, s in got if i is None or i in (0, 3, 57)]
    assert min(bad) > 0.5 and max(s for i, s in got if i in (1, 2, 101, 102)) < 0.5
    clash = docs.withColumn("__score", docs["score"]).withColumn("Score_", docs["score"])
    carried = toxicity.score(clash, model, carry=True)
    assert carried.columns == [*clash.columns, "score__"] and carried.count() == docs.count()
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.fit(toxicity.training_rows(docs, labels.where("toxic = 0"))) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
