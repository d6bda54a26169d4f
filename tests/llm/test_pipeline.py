from collections import Counter

import __spark_entry__
import corpus_pipeline
from tests.llm import test_near_dedup, test_packing
from veilstream.llm import mixing, quality_net, secrets
from veilstream.llm.common import cut

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark, docs):
    """Each stage on its predecessor's rows: what it takes out, changes and keeps."""
    columns = docs.columns
    rows = lambda df: [tuple(r) for r in df.collect()]
    (_, quality), (_, dedup), (_, redact), (_, mix), (_, pack) = corpus_pipeline.STAGES
    at = {c: columns.index(c) for c in ("doc_id", "text", "source")}

    first = cut(quality(spark, docs, SF))
    scores = {r.doc_id: r.score for r in quality_net.quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert first.columns == columns and Counter(rows(first)) == Counter(r for r in rows(docs) if scores[r[at["doc_id"]]] >= quality_net.THRESHOLD)

    second = cut(dedup(spark, first, SF))
    want = test_near_dedup.brute_deduplicated([(r[at["doc_id"]], r[at["text"]]) for r in rows(first)])
    assert second.columns == columns and Counter(r[at["doc_id"]] for r in rows(second)) == Counter(d for d, _ in want)
    assert set(rows(second)) <= set(rows(first))

    third = cut(redact(spark, second, SF))
    assert third.columns == columns
    spans = {r.doc_id: list(zip(r.starts, r.ends, strict=True)) for r in secrets.scan(second).collect()}

    def redacted(row):
        text, out = row[at["text"]], ""
        gone = {k for s, e in spans[row[at["doc_id"]]] for k in range(s, e)}
        starts = {s for s, _ in spans[row[at["doc_id"]]] if s - 1 not in gone or any(e == s for _, e in spans[row[at["doc_id"]]])}
        for k, c in enumerate(text or ""):
            out += "[SECRET]" if k in starts else ""
            out += "" if k in gone else c
        return (*row[: at["text"]], out if text is not None else None, *row[at["text"] + 1 :])

    assert Counter(rows(third)) == Counter(map(redacted, rows(second)))
    assert sum(len(s) for s in spans.values()) > 0

    fourth = cut(mix(spark, third, SF))
    plan = mixing.mix(third, mixing.MISS).collect()
    words = lambda t: len(test_near_dedup.WORD.findall(t or ""))
    got = Counter()
    for r in rows(fourth):
        got[r[at["source"]]] += words(r[at["text"]])
    taken = Counter()
    for r in plan:
        taken[r.source] += r.taken
    assert fourth.columns == columns and +got == +taken
    known = {r[at["doc_id"]]: r[at["text"]] for r in rows(third)}
    assert all(known[r[at["doc_id"]]].startswith(r[at["text"]]) for r in rows(fourth))

    texts = [(r[at["doc_id"]], r[at["text"]]) for r in rows(fourth)]
    n, least = test_packing.held(pack(spark, fourth, SF).collect(), texts)
    assert n <= least * 1.1 + 1
    assert corpus_pipeline.run(spark, SF).count() == pack(spark, fourth, SF).count()


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
