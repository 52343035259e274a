import math
import random
import re

from wayspan.llm import licenses as lic

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, templates):
    out = []
    for name, text in templates.items():
        t = words(text)
        k = 2 if len(t) < lic.SHORT else 5
        own = {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}
        w = next(x for x in lic.SIZES if len(t) <= x - x // 4 + 1)
        reach, need = w - w // 4 + 1, math.ceil(0.8 * len(own) - 1e-9)
        for d, text in docs:
            x = words(text)
            best, first = 0, None
            for s in range(max(1, len(x) - reach + 1)):
                span = x[s : s + reach]
                held = len(own & {tuple(span[i : i + k]) for i in range(len(span) - k + 1)})
                best = max(best, held)
                if held >= need and first is None:
                    first = s
            if first is not None:
                out.append((d, name, best, len(own), first))
    return sorted(out, key=repr)


def test_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in lic.op1_license_scan(spark, sf).collect()), key=repr)
    assert got == brute(docs, lic.TEMPLATES)
    assert len({r[1] for r in got}) >= 4


def test_edited_notices_and_odd_rows(spark):
    rnd = random.Random(3)
    docs = []
    for i in range(60):
        text = rnd.choice(list(lic.TEMPLATES.values())).split()
        for _ in range(rnd.randrange(0, max(2, len(text) // 6))):
            text[rnd.randrange(len(text))] = rnd.choice(["altered", "the", "license"])
        pad = [rnd.choice(["alpha", "the", "under", "license", "ünï"]) for _ in range(rnd.randrange(0, 80))]
        docs.append((i, " ".join(pad + text + pad[: rnd.randrange(0, 9)])))
    docs += [(100, None), (101, ""), (102, "All"), (103, "All rights\n\nRESERVED"), (103, "All rights\n\nRESERVED"), (None, "all rights reserved " * 20000)]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, license string")
    got = sorted((tuple(r) for r in lic.license_matches(frame).collect()), key=repr)
    assert got == brute(docs, lic.TEMPLATES)
    assert lic.license_matches(frame.limit(0)).count() == 0


def test_bands_guarantee_retrieval():
    for j in (0.2, 0.5, 0.8):
        assert (1 - j) ** lic.bands_for(j) <= lic.MISSED


def test_templates_of_whole_licenses(spark):
    rnd = random.Random(12)
    long = " ".join(rnd.choice("the of a license work source code party grant claim notice terms contributor patent".split()) + str(rnd.randrange(400)) for _ in range(1800))
    own = long.split()
    for i in range(0, 1800, 90):
        own[i] = "changed"
    docs = spark.createDataFrame([(1, "before " * 700 + " ".join(own) + " after" * 300), (2, " ".join(own[:900]))], "doc_id long, text string")
    rows = lic.license_matches(docs, {"long": long, "short": "Released under the MIT License."}).collect()
    assert [(r.doc_id, r.license) for r in rows] == [(1, "long")] and rows[0].n_found >= 0.8 * rows[0].n_shingles
