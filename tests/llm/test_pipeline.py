import random

from conftest import ODD, prose


def test_pipeline(spark, folder):
    """Stage by stage against what the rows are known to be."""
    import corpus_pipeline

    rng = random.Random(21)
    item = "the planted item of the benchmark has these words and no others do at all"
    line = "this one line is in many of the documents and long enough to go"
    clean = {1000 + i: "\n".join(prose(rng, 40) for _ in range(3)) for i in range(30)}
    rows = list(clean.items())
    rows += [(2000 + i, t) for i, t in clean.items() if i < 1005]  # exact copies
    rows += [(3000 + i, t.replace(t.split()[60], "changed", 1)) for i, t in clean.items() if 1005 <= i < 1010]  # near copies
    rows += [(300, prose(rng, 60) + " " + item + " " + prose(rng, 30))]
    rows += [(400 + i, line + "\n" + prose(rng, 80)) for i in range(6)]
    rows += [(500, "buy " * 100), (501, "too short")] + ODD
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, folder(rows, [(1, item)])).collect()}
    assert set(out) == set(clean) | {400, 401, 402, 403, 404, 405}
    from tokenizers import Tokenizer

    from tokenloom.llm import bpe

    library = Tokenizer.from_file(bpe.default_vocabulary())
    text = dict(rows)
    assert all(out[i].n_tokens == len(library.encode(text[i], add_special_tokens=False).ids) for i in clean)
    assert out[405].n_tokens == len(library.encode(text[405], add_special_tokens=False).ids)
    assert out[400].n_tokens == len(library.encode(text[400].split("\n", 1)[1], add_special_tokens=False).ids)


def test_stages():
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "bpe"]
