import itertools
import random
import re

from loomdex.llm.licenses import GAP, PHRASES, SKIP, TEMPLATES, Match, Scanner, chained, chains, op6_license_scan, scan_licenses, whole_templates, words_of


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at, labels = [i for i, _ in hits], sorted({x for _, x in hits})
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(labels)


def test_words():
    for text in ("A-b_c9É é²x\x7fy\x00z [MIT] License", "", None, "\x1c\x85a\xa0b"):
        assert [w.decode() for w in words_of(text)] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_query_equals_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op6_license_scan(spark, sf_dir).collect()
    assert len(got) == len(docs) and any(r["n_base"] for r in got)
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(docs[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) | {""}
        assert 0 <= r["score"] <= 1


def test_matching_statistics_equal_brute_force():
    s = Scanner()
    coded = {n: [s.ids[w.encode()] for w in TEMPLATES[n].split()] for n in s.names}
    text = coded["bsd"][3:20] + coded["mit"][:9] + [s.ids[b"the"]] * 3 + coded["gpl"][30:50]
    lengths, states = s.automaton.statistics(text)
    for i in range(len(text)):
        runs = {n: max(k for k in range(i + 2) if k == 0 or any(c[j : j + k] == text[i + 1 - k : i + 1] for j in range(len(c) - k + 1))) for n, c in coded.items()}
        assert lengths[i] == max(runs.values())
        k = lengths[i]
        assert sorted(s.automaton.ends[states[i]] if k else []) == sorted((t, j + k) for t, n in enumerate(s.names) for j in range(len(coded[n]) - k + 1) if k and coded[n][j : j + k] == text[i + 1 - k : i + 1])


def test_spans_of_templates_with_changes(spark):
    words = TEMPLATES["bsd"].split()
    text = "intro text " + " ".join(words[:20]) + " ODD " + ", ".join(words[21:]).upper() + " end"
    rows = [(1, text, 0), (1, text, 0), (2, None, 1), (None, "see the general public license general public license", 2), (3, "the of and to in " * 20000, 3)]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, hits int")).collect()
    first = [r for r in got if r["doc_id"] == 1]
    assert len(first) == 2 and [s["label"] for s in first[0]["spans"]] == ["bsd"]
    assert first[0]["spans"][0]["first"] == 2 and first[0]["spans"][0]["end"] == 2 + len(words)
    assert [h["word"] for r in got if r["doc_id"] is None for h in r["hits"]] == [2, 5]
    assert not [s for r in got if r["doc_id"] in (2, 3) for s in r["spans"]]
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chains_equal_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        matches = sorted((Match(a, a + n, t + n) for a, n, t in ((rng.randrange(30), rng.randrange(5, 9), rng.randrange(40)) for _ in range(rng.randrange(1, 7)))), key=lambda m: m.end)
        best = 0
        for size in range(1, len(matches) + 1):
            for chain in itertools.combinations(matches, size):
                total = chain[0].end - chain[0].start
                for a, b in itertools.pairwise(chain):
                    gap, skip = b.start - a.end, b.to - (b.end - b.start) - a.to
                    new = b.end - b.start - max(0, -gap, -skip)
                    total = total + new if gap <= GAP and skip <= SKIP and new > 0 else -(10**6)
                best = max(best, total)
        assert max(chained(matches)[0]) == best and chains(matches, best)[0][2] == best and chains(matches, best + 1) == []


def test_words_of_a_template_count_once():
    """The same run of a template over and over covers no more of it; whole templates do, each on its own."""
    s = Scanner()
    run = "the software and to permit persons "
    assert s.scan("".join(run + f"x{i} " for i in range(3)))[2] == []
    whole = TEMPLATES["isc"] + " "
    n = len(whole.split())
    assert [x[:4] for x in s.scan(whole + whole + "and more")[2]] == [("isc", 0, n, n), ("isc", n, 2 * n, n)]
    assert len(s.scan(whole * 3000)[2]) == 3000
    # backwards parts are no span of the template
    words = whole.split()
    assert max((x[3] for x in s.scan(" ".join(words[20:30] + words[5:16]))[2]), default=0) <= 11
    # the better covered one of two templates that share words
    assert {x[0] for x in s.scan(TEMPLATES["lgpl"])[2]} == {"lgpl"} and {x[0] for x in s.scan(TEMPLATES["gpl"])[2]} == {"gpl"}


def test_bodies_of_licences_without_their_phrases(spark, tmp_path):
    """Parts of whole licence texts that hold none of the phrases give the label, and the score follows what they cover."""
    whole = whole_templates()
    part = lambda name, a, b: " ".join(whole[name].split()[a:b])
    bodies = {"mit": part("mit.text", 115, 175), "apache": part("apache.2.0.text", 300, 420), "gpl": part("gpl.3.text", 900, 1100), "mpl": part("mpl.2.0.text", 400, 520), "bsd": part("bsd.3.text", 130, 200), "lgpl": part("lgpl.2.1.text", 1500, 1600)}
    assert not any(p in text for text in bodies.values() for p in PHRASES)
    rows = [(i, f"before all, {text.upper()} and after") for i, text in enumerate(bodies.values())] + [(90, "an mit license here"), (91, "a text of its own that speaks of permission and of software, and of nothing else"), (92, whole["isc.text"])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op6_license_scan(spark, str(tmp_path)).collect()}
    assert [got[i]["labels"] for i in range(len(bodies))] == list(bodies) and not any(got[i]["base_labels"] for i in range(len(bodies)))
    assert all(0 < got[i]["score"] < 1 for i in range(len(bodies))) and got[0]["score"] > got[2]["score"]
    assert (got[90]["labels"], round(got[90]["score"], 9)) == ("mit", 0.9) and (got[91]["labels"], got[91]["score"]) == ("", 0.0) and (got[92]["labels"], got[92]["score"]) == ("isc", 1.0)
