"""All operators on a table whose other columns bear the names that they use inside."""

import pytest
from public_tokenizers import path as vocabulary
from pyspark.sql import functions as F

from lorekeep.llm import chat, fingerprints, language, licenses, ngram_join, packing, quality, seekable, sentencepieces, toxicity, turn_repair, turn_trie, urls

NAMES = ["label", "score", "rows", "id", "text_", "n", "key", "of", "a", "b", "s", "c", "said", "conv", "turns", "ids", "chars", "copies", "seen", "lang_pred", "component", "word",
         "words", "features", "prediction", "weight", "address", "host", "path", "found", "rule", "node", "parent", "leaf", "place", "_id", "_text", "_hash", "_place", "start",
         "length", "bucket", "kind", "level", "many", "lowest", "kept", "n_words", "fingerprint", "hashes", "size", "at"]


@pytest.fixture(scope="module")
def documents(spark):
    texts = [f"Plain words number {i} about the river and the town." for i in range(30)] + ["You vile scum, get lost you scum.", "Scum like you, vile scum.", None, "", "été déjà vu là-bas"]
    frame = spark.createDataFrame([(i, t, ("en", "fr")[i % 2], int("cum" in (t or ""))) for i, t in enumerate(texts)], "doc_id long, text string, lang string, toxic int")
    return frame.select("*", *[F.lit("x").alias(n) for n in NAMES])


def rows(frame):
    return len(frame.collect())


def test_documents(spark, documents):
    count = documents.count()
    labels = documents.select("doc_id", "toxic", *NAMES)
    assert rows(toxicity.score(documents, toxicity.learn(documents, labels))) == count
    assert rows(language.predict(documents, language.learn_sample(documents))) == count
    model = language.learn_sample(documents)
    assert rows(language.predict(documents, model, least=language.least_cosines(documents, model))) == count
    assert rows(ngram_join.near_duplicates(documents)) == count
    assert rows(quality.judge(documents)) == count
    assert rows(licenses.scan(documents)) == count
    assert rows(fingerprints.edited(documents)) == count
    assert rows(packing.pack(documents, vocabulary("word_bpe_49k.json"))) >= count
    pieces = vocabulary("piece_bpe_32k.model")
    assert rows(sentencepieces.decode(sentencepieces.encode(documents, pieces), pieces)) == count
    assert rows(seekable.read(seekable.write(documents, vocabulary("byte_bpe_50k.json")))) == count


def test_pages_and_conversations(spark, documents):
    pages = documents.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://x.org/"), "doc_id").alias("url"), *NAMES)
    assert rows(urls.judge(pages, [("allow", "org/1"), ("block", "org/2")])) == documents.count()
    talk = documents.select(F.lit(1).cast("long").alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("user").alias("role"), "text", *NAMES)
    assert rows(chat.read_back(chat.formatted(chat.chain(talk)))) == 1
    assert rows(turn_repair.repair(talk)) == 1
    assert rows(turn_trie.trie(turn_trie.turns(talk))) == documents.count() + 1
