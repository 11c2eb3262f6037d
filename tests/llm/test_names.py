"""Every operator over a frame whose other columns have the names that operators use inside."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from passbook.llm import alignment, bpe, licences, linededup, mixing, neardup, spotsigs, suffix_dedup, tokenfile, toxicity, urlfilter

NAMES = """id tag held body cell_source cell_rate cell_ratio Key Range KIND lo hi null rid TK more own number block digest tokens doc keep at n row shard
    _id _tag _held _text _null _rid _tk _source _lang _topic _ratio _rate _repeats _key _range _kind _lo _hi _bucket _lead _head _over next sigs
    rate ratio repeats_ gone times head start place anchor seg salt radix groups_ hi_ lo_ key_ range_ kind_""".split()
TEXTS = ["one two three four five six seven the cat", "one two three four five six seven the cat", "", None, "Alone it stands, the very last of words " * 12]


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.createDataFrame([(i if i != 2 else None, t, "en", "web", f"http://a.com/{i}") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, url string")
    return base.withColumns({n: F.lit(f"{n}!") for n in NAMES} | {"Map": F.create_map(F.lit("a"), F.lit(1))}).cache()


def untouched(got, docs, rows=len(TEXTS)):
    """The other columns are there, once, and hold what they held."""
    assert [c for c in got.columns if c in NAMES or c == "Map"] == [*NAMES, "Map"]
    found = got.select(*NAMES, "Map").collect()
    assert len(found) == rows
    assert all(r[n] == f"{n}!" for r in found for n in NAMES) and all(r.Map == {"a": 1} for r in found)


def test_operators_that_keep_columns(spark, docs):
    a, b, ranks = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"))
    untouched(mixing.mixed(docs), docs)
    untouched(suffix_dedup.cut_repeats(docs), docs)
    untouched(urlfilter.judge(docs, spark.createDataFrame([("com", "/", "block")], "host string, path string, verdict string")), docs)
    untouched(neardup.deduplicated(docs), docs, 4)
    untouched(linededup.cut_lines(docs), docs)
    untouched(alignment.aligned(docs, a, b), docs)
    untouched(bpe.encode_texts(docs, ranks, public_tokenizers.PATTERN), docs)
    labels = spark.createDataFrame([(0, 1), (4, 0)], "doc_id long, toxic int")
    untouched(toxicity.score(docs, toxicity.train(docs, labels)), docs)


def test_operators_that_leave_columns_out(spark, docs):
    assert suffix_dedup.cut_repeats(docs, digest=True).count() == len(TEXTS)
    assert neardup.clusters(docs).count() == len(TEXTS)
    assert spotsigs.edited_fingerprints(docs).count() == len(TEXTS)
    assert licences.scan(docs, *licences.known_rules(spark)).count() == 0
    path = tokenfile.write(docs, public_tokenizers.path("byte_bpe_50k.json"))
    assert tokenfile.summary(spark, path).count() == len(TEXTS)
