"""Each stage of the pipeline, on what the one before it kept, against a brute-force version of it."""

from collections import Counter

import numpy as np
import pytest
from test_free import groups, print_of

import corpus_pipeline as pipeline
from herald.llm import bpe, common, language, lines, mixing

SPACE = " \t\n\r\x0b\x0c"


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """(docs, rows) of the table and of each stage's result."""
    root = tmp_path_factory.mktemp("stages")
    near = "the quick brown fox jumps over the lazy dog and runs far away into the deep dark forest at night number "
    base = " ".join(f"mot{i} de la" for i in range(80))
    more = [near + "1", near + "2\nother line of its own", None, "", "12 34", "qxzj vkwp zzqx jjkv", base, base.replace("mot7 ", "mit7 ", 1), base.replace("mot9 ", "mit9 ", 1), near + "1"]
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 120")
    docs = table.union(spark.createDataFrame([(10**6 + k, t, None, f"s{k % 2}", len(t or "")) for k, t in enumerate(more)], table.schema))
    made = {"documents": docs}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(root / name))
        docs = made[name] = spark.read.parquet(str(root / name))
    return {name: (df, df.collect()) for name, df in made.items()}


def chain(scores, transitions):
    """Posteriors of one chain, step by step."""
    e, t = np.exp(scores - scores.max(axis=1, keepdims=True)), np.exp(transitions)
    forward, backward = [e[0] / e[0].sum()], [np.ones(e.shape[1])]
    for x in e[1:]:
        f = (forward[-1] @ t) * x
        forward.append(f / f.sum())
    for x in e[:0:-1]:
        b = t @ (x * backward[-1])
        backward.append(b / b.sum())
    p = np.array(forward) * np.array(backward[::-1])
    return p / p.sum(axis=1, keepdims=True)


def test_language_stage(stages):
    docs, rows = stages["documents"]
    model, want = language.train(*language.training_rows(docs)), {}
    for r in rows:
        words = language.words_of(r["text"])
        if not words:
            continue
        found = chain(language.word_scores(words, model), model.transitions).mean(axis=0)
        known = np.mean([np.mean(model.seen[language.features([w], model.lexicon)[0]]) >= 0.5 for w in words])
        if known >= pipeline.LEAST_FAMILIAR:
            want[r["doc_id"]] = model.languages[int(found.argmax())]
    assert {r["doc_id"]: r["lang"] for r in stages["language_id"][1]} == want
    assert 10**6 + 5 not in want and len(want) > 100


def test_line_stage(stages):
    docs, _ = stages["language_id"]
    found = {}
    for r in common.keyed(docs, "doc_id", "text").select("row_key", "doc_id", "text").collect():
        for i, line in enumerate(r["text"].split("\n")):
            if line.strip(SPACE):
                found[r["doc_id"], r["row_key"], i] = line
    texts = list(dict.fromkeys(found.values()))
    sets = [{t[i : i + lines.SHINGLE] for i in range(max(1, len(t) - lines.SHINGLE + 1))} for t in texts]
    top = groups(len(texts), [(j, i) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    of = dict(zip(texts, top))
    first, gone = {}, set()
    for k in sorted(found):
        if first.setdefault(of[found[k]], k) != k:
            gone.add(k)
    want = {}
    for r in common.keyed(docs, "doc_id", "text").select("row_key", "doc_id", "text").collect():
        want[r["doc_id"]] = "\n".join(x for i, x in enumerate(r["text"].split("\n")) if (r["doc_id"], r["row_key"], i) not in gone)
    assert {r["doc_id"]: r["text"] for r in stages["line_dedup"][1]} == want and gone
    assert all(r["n_chars"] == len(r["text"]) for r in stages["line_dedup"][1])


def test_near_stage(stages):
    rows = sorted(stages["line_dedup"][1], key=lambda r: r["doc_id"])
    prints = [print_of(r["text"]) for r in rows]
    top = groups(len(rows), [(j, i) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    assert {r["doc_id"]: r["text"] for r in stages["near_dedup"][1]} == {rows[t]["doc_id"]: rows[t]["text"] for t in set(top)}
    assert len(set(top)) < len(rows)


def test_mix_stage(stages):
    """The blocks that the mix draws, cut out of each source's words by hand."""
    docs, rows = stages["near_dedup"]
    texts = {r["doc_id"]: r["text"] for r in rows}
    made = mixing.mix(common.keyed(docs, "doc_id", "text", "source"), row="row_key")
    streams = {}
    for r in sorted(made["documents"].where("size > 0").collect(), key=lambda r: r["start"]):
        stream = streams.setdefault(r["rank"], [])
        assert r["start"] == len(stream)
        stream += [(r["doc_id"], w) for w in texts[r["doc_id"]].split()]
    want = Counter()
    for s in made["slots"].collect():
        part = streams[s["rank"]][s["block"] * mixing.BLOCK : (s["block"] + 1) * mixing.BLOCK]
        for doc in dict.fromkeys(d for d, _ in part):
            want[doc, " ".join(w for d, w in part if d == doc)] += 1
    assert Counter((r["doc_id"], r["text"]) for r in stages["mix_sources"][1]) == want


def test_token_stage(stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary())
    library.no_truncation()
    library.no_padding()
    want = Counter()
    for r in stages["mix_sources"][1]:
        ids = library.encode(r["text"], add_special_tokens=False).ids
        want[r["doc_id"], tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in stages["tokenize"][1]) == want
