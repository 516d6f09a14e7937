import random

from runmerge.llm import toxicity

LEARNED = ["zorgelig", "drumpfen", "blattrig", "quelk"]


def test_learned_and_short_terms_are_matched_misspelt(spark):
    rng = random.Random(3)
    words = lambda n: [f"word{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(n)]
    rows = []
    for i in range(300):
        toxic = int(i % 5 == 0)
        text = words(20) + (rng.sample(LEARNED, 3) if toxic else ["quelle"] if i % 7 == 0 else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text), toxic))
    table = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.fit(table.drop("toxic"), table.drop("text"))
    assert set(LEARNED) <= set(model.counts)
    clean = " ".join(words(20))
    texts = [clean, f"{clean} zorgelik drumfen blatttrig", f"{clean} quelle quelle quelle", f"{clean} zorgelig drumpfen blattrig"]
    scored = toxicity.score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).orderBy("doc_id").collect()
    assert [r["predicted"] for r in scored] == [0, 1, 0, 1]
    assert scored[1]["score"] <= scored[3]["score"]
    lexicon = toxicity.ToxicityModel({t: (3.0, 0.0) for t in toxicity.SEEDS}, (3.0, 3.0)).lexicon()
    assert lexicon.match("scvm") == ("scum", 1) and lexicon.match("dvmb") == ("dumb", 1)
