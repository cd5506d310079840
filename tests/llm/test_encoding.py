import random

import pytest
from gleanix.llm import encoding as E
from tests_llm_rows import T0, T1

SOUND = [
    "Le théâtre fermé près de la rivière, où l’été arrive à Paris – café crème.",
    "Die große Straße führt über die Brücke; weiß, müde und schön. 20 °C",
    "El niño pidió más azúcar y después llegó mañana, ¿por qué está aquí?",
]
TRAPS = [
    "The letters Â, Ã and Ð stand at the head, next to © and ®.",
    "A palavra MAÇÃ aparece no mapa antigo, perto de SÃO e de CORAÇÃO.",
    "Âncora e Âmbar são nomes de barcos; ÂNGULO é o nome do cais.",
    "One side is √2 and the other is √3 of the length.",
    "The listing shows ├── index │ └── block and ends.",
    "Город стоит у реки, и мост ведёт к старой мельнице.",
    "The label reads Γ and Ω for the two coils, ≈ 3 turns, marked ¬ and ¦.",
    "Er mag Fuß… und Spaß“ sehr, CAFÉ» auch.",
    "An entity &#233; and &amp; alone are sound.",
]


def garble(text: str, codec: str) -> str:
    back = {b: c for c, b in E._reader(codec)[1].items()}
    return "".join(c if c.isascii() else "".join(back[b] for b in c.encode()) for c in text)


@pytest.mark.parametrize("codec", E.CODECS)
@pytest.mark.parametrize("text", SOUND)
def test_undo_is_exact(codec, text):
    assert E.undo(garble(text, codec), codec) == text
    assert E.undo(garble(garble(text, codec), codec), codec) == garble(text, codec)


@pytest.mark.parametrize("text", TRAPS[:7])
def test_sound_text_has_no_or_little_trace(text):
    assert E.undo(text, "cp1252") == text


def test_entities_and_lost_text():
    hidden = "".join(f"&#{ord(c)};" if not c.isascii() else c for c in garble("café à", "cp1252"))
    assert E.repair(hidden, "entity>cp1252") == "café à"
    assert E.repair("caf�", E.LOST) is None
    assert E.repair("LÃ  oÃ¹", "cp1252") == "Là où"


def test_sound_parts_of_a_garbled_text_are_not_touched():
    assert E.repair("MANHÃ E CAFÃ©", "cp1252") == "MANHÃ E CAFé"
    assert E.repair("MANHÃ , CAFÃ©", "cp1252") == "MANHÃ , CAFé"
    text = "use &lt;b&gt; in cafÃ© &amp; th&eacute;"
    assert [chain for chain, _ in E.evidence(text) if chain in ("cp1252", "entity>cp1252")] == ["cp1252"]
    assert E.repair(text, "cp1252") == "use &lt;b&gt; in café &amp; th&eacute;"
    hidden = "use &lt;b&gt; in caf&Atilde;&copy; &amp; th&eacute;"
    assert "entity>cp1252" in dict(E.evidence(hidden)) and "cp1252" not in dict(E.evidence(hidden))
    assert E.repair(hidden, "entity>cp1252") == "use &lt;b&gt; in café &amp; th&eacute;"


def _rows(n: int = 400):
    rng = random.Random(9)
    rows, bad = [], {}
    for i in range(n):
        text = " ".join(rng.sample(SOUND, 2))
        feed = "good" if i % 4 else "bad"
        if feed == "bad" and i % 8 == 0:
            codec = rng.choice(["cp1252", "latin-1", "cp437", "cp850", "cp1251", "mac_roman"])
            bad[i] = text
            text = garble(text, codec)
        elif i % 50 == 2:
            bad[i] = text
            text = text[:20] + garble(text[20:], "cp1252")  # in part
        elif i % 50 == 7:
            bad[i] = None
            text = text.encode("latin-1", "ignore").decode("utf-8", "replace")
        elif i % 50 == 11:
            bad[i] = text
            text = garble(garble(text, "cp1252"), "cp1252")
        elif i % 10 == 3:
            text = text + " " + TRAPS[i // 10 % len(TRAPS)]
        rows.append((i, text, feed, T0))
    return rows, bad


def test_found_and_restored(spark, tables):
    rows, bad = _rows()
    rows += [(1000, None, "good", T0), (1001, "", None, T0), (1002, "plain ascii " * 20_000, "good", T0), (1003, garble("naïve café", "cp1252"), None, T0), (0, rows[0][1], "bad", T1)]
    bad[1003] = "naïve café"
    data = tables(extra="chain,posterior,r,c,n,garbled", collection_tsv=rows)
    assert {r.doc_id for r in E.found(spark, data).collect()} == set(bad)
    got = {r.doc_id: r.doc_in for r in E.restored(spark, data).collect()}
    assert got == bad


def test_feeds_not_used_for_any_constant(spark):
    """Held out: feeds of other words, each with its own codec and share of garbled records, some of one short word only."""
    rng = random.Random(77)
    words = "fenêtre pêche Übung Käse señal cañón höher früh déjà naïf garçon Öl Spaß élan jalapeño".split()
    plain = "the river runs past a mill and an old bridge of stone in autumn".split()
    rows, bad = [], set()
    for i in range(1500):
        feed = i % 5
        text = " ".join(rng.sample(plain, 6) + rng.sample(words, rng.choice([1, 1, 2, 4])))
        if rng.random() < (0.0, 0.02, 0.1, 0.3, 0.9)[feed]:
            text = garble(text, ("cp1252", "cp1252", "mac_roman", "cp1250", "cp437")[feed])
            bad.add(i)
        rows.append((i, text, f"feed {feed}"))
    got = {r.doc_id for r in E.best_chain(E.posteriors(spark.createDataFrame(rows, "doc_id BIGINT, doc_in STRING, feed STRING"))).collect()}
    assert len(got & bad) >= 0.98 * len(bad) and len(got - bad) <= 0.02 * len(got)


def test_weak_evidence_counts_more_in_a_bad_feed(spark):
    rows = [(i, "bad", garble("Größe über café", "cp1252")) for i in range(60)] + [(i, "good", "Größe über café ß… CAFÉ»") for i in range(100, 400)]
    rows += [(990, "bad", "only Â° here"), (991, "good", "only Â° here")]
    post = E.posteriors(spark.createDataFrame(rows, "doc_id BIGINT, feed STRING, doc_in STRING"))
    weak = {r.doc_id: r.posterior for r in post.groupBy("doc_id").sum("posterior").withColumnRenamed("sum(posterior)", "posterior").where("doc_id > 900").collect()}
    assert weak[990] >= weak[991]


def test_empty_tables(spark, tables):
    data = tables()
    assert E.found(spark, data).collect() == E.restored(spark, data).collect() == []
    data = tables(collection_tsv=[(1, None, None, None), (None, "Ã©", "f", T0)])
    assert E.found(spark, data).collect() == []


def test_a_round_is_few_exchanges(spark):
    """The driver keeps a thread for each exchange and broadcast for a minute; fourteen a round took more memory than it has."""
    docs = spark.createDataFrame([(i, f"feed {i % 3}", garble(SOUND[i % 3], "cp1252") if i % 2 else SOUND[i % 3]) for i in range(60)], "doc_id BIGINT, feed STRING, doc_in STRING")
    store = spark._jsparkSession.sharedState().statusStore()

    def runs() -> set[int]:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        kept = store.executionsList()  # the last thousand
        return {kept.apply(k).executionId() for k in range(kept.size())}

    def exchanges(rounds: int) -> int:
        before = runs()
        E.posteriors(docs, most_rounds=rounds, settled=-1.0)
        graphs = [store.planGraph(run).allNodes() for run in runs() - before]
        return sum(g.apply(k).name().endswith("Exchange") for g in graphs for k in range(g.size()))

    assert 0 < exchanges(5) - exchanges(2) <= 3 * 6
