from __future__ import annotations

import math
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lumenseek.config import Settings
from lumenseek.operators import batching, reports
from lumenseek.operators.embedding import embed, retry_failed
from lumenseek.providers import embedding as em, expansion as ex, health
from lumenseek.providers.batching import BatchEmbedder, BatchPolicy
from lumenseek.providers.transport import HttpFailure, RequestBudget, ServiceError, hosted_error, local_error


def embedder(fn, **options):
    return BatchEmbedder(fn, sleep=lambda s: None, **options)


class Scripted:
    """Answers call after call from a list; exceptions are raised."""

    def __init__(self, *answers):
        self.answers, self.calls = list(answers), []

    def __call__(self, texts):
        self.calls.append(list(texts))
        answer = self.answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer


def test_batches_keep_order():
    fn = Scripted([[1.0], [2.0]], [[3.0]])
    done = embedder(fn, batch_size=2).run(["a", "b", "c"])
    assert len(fn.calls) == 2 and done.vectors == [[1.0], [2.0], [3.0]]
    assert (done.success_count, done.failure_count) == (3, 0)


def test_retry_then_success():
    fn = Scripted(RuntimeError("x"), RuntimeError("x"), [[1.0], [2.0]])
    slept = []
    run = BatchEmbedder(fn, batch_size=2, tries=3, sleep=slept.append)
    done = run.run(["a", "b"])
    assert len(fn.calls) == 3 and done.success_count == 2 and slept == [1, 2]


def test_fallback_to_single_calls_keeps_the_batch_size():
    fn = Scripted(RuntimeError("batch"), [[1.0]], [[2.0]])
    run = embedder(fn, batch_size=4, tries=1)
    assert run.run(["a", "b"]).vectors == [[1.0], [2.0]]
    assert len(fn.calls) == 3 and run.policy.size == 4


def test_partial_failure_keeps_index_and_error():
    done = embedder(Scripted([[1.0], []], [[3.0]]), batch_size=2).run(["a", "b", "c"])
    assert (done.success_count, done.failure_count, done.failed) == (2, 1, [1])
    done = embedder(Scripted(RuntimeError("x"), [[1.0]], RuntimeError("bad text")), batch_size=2, tries=1).run(["a", "b"])
    assert done.vectors == [[1.0], []] and done.errors == {1: "bad text"}


def test_whole_failure_halves_the_batch_size():
    run = embedder(Scripted(*[RuntimeError("x")] * 3), batch_size=8, tries=1)
    assert run.run(["a", "b"]).failed == [0, 1] and run.policy.size == 4


def test_wrong_number_of_vectors_is_a_failure():
    assert embedder(Scripted([[1.0]], [[1.0]], [[2.0]]), tries=1).run(["a", "b"]).vectors == [[1.0], [2.0]]


def test_progress_and_empty_input():
    seen = []
    embedder(Scripted([[1.0]] * 2, [[1.0]] * 2), batch_size=2).run(list("abcd"), lambda a, b: seen.append((a, b)))
    assert seen == [(2, 4), (4, 4)]
    done = embedder(Scripted()).run([])
    assert (done.vectors, done.success_count, done.failure_count) == ([], 0, 0)


def test_batch_policy():
    policy = BatchPolicy(32)
    assert policy.adjust(True) == 40 and policy.adjust(False) == 20
    policy.set_size(90)
    assert policy.adjust(True) == 100
    policy.set_size(1)
    assert policy.adjust(False) == 1
    with pytest.raises(ValueError):
        policy.set_size(101)


def test_hash_provider_is_unit_length_and_additive():
    provider = em.HashProvider(16)
    one, again, blank = provider.embed(["the cat the", "The  cat the", " "])
    assert one == again and math.isclose(sum(v * v for v in one), 1.0) and blank == [0.0] * 16


class FakeTransport:
    def __init__(self, **replies):
        self.replies, self.sent = replies, []

    def call(self, path, body=None, timeout=None):
        self.sent.append((path, body))
        reply = self.replies[path.strip("/").replace("/", "_")]
        if isinstance(reply, Exception):
            raise reply
        return reply(body) if callable(reply) else reply


def test_local_provider():
    transport = FakeTransport(api_embeddings={"embedding": [3.0, 4.0]},
                              api_tags={"models": [{"name": "nomic-embed-text:latest"}]})
    provider = em.LocalServerProvider("nomic-embed-text", transport=transport)
    assert provider.embed(["a"]) == [[0.6, 0.8]]
    assert provider.check_connection() and provider.is_model_available()
    assert not em.LocalServerProvider("mxbai-embed-large", transport=transport).is_model_available()
    down = em.LocalServerProvider("nomic-embed-text", transport=FakeTransport(
        api_embeddings=HttpFailure(code="ECONNREFUSED"), api_tags=HttpFailure(code="ECONNREFUSED")))
    assert not down.check_connection() and not down.is_model_available()
    with pytest.raises(ServiceError, match="Is it running"):
        down.embed_query("a")


def test_one_bad_text_disturbs_no_other():
    def reply(body):
        if body["prompt"] == "bad":
            raise HttpFailure(status=500)
        return {"embedding": [3.0, 4.0]}

    waits = []
    transport = FakeTransport(api_embeddings=reply)
    provider = em.LocalServerProvider("nomic-embed-text", transport=transport, sleep=waits.append)
    texts = ["good"] * 31 + ["bad"]
    done = BatchEmbedder(provider.embed, failures=lambda: provider.failures, sleep=waits.append, pause=0).run(texts)
    assert done.vectors == [[0.6, 0.8]] * 31 + [[]] and done.failed == [31] and set(done.errors) == {31}
    assert len(transport.sent) == 31 + 3 and waits == [1, 2, 4]


def test_tasks_share_the_request_budget():
    provider = em.HostedProvider("text-embedding-3-small", "k", transport=FakeTransport())
    provider.shared_by(4)
    assert provider.per_minute == provider.budget.per_minute == 125


class CountingService:
    """Answers with the number of texts in the request."""

    def call(self, path, body=None, **_):
        return {"data": [{"index": i, "embedding": [len(body["input"])]} for i in range(len(body["input"]))]}


def test_a_service_without_limit_gets_full_requests_and_no_waits(spark):
    provider = em.HostedProvider("text-embedding-3-small", "k", transport=CountingService(), per_minute=None)
    provider.shared_by(4)
    assert provider.per_minute is None and provider.budget is None
    texts = spark.range(0, 250, 1, 1).select(F.col("id").cast("string").alias("text"))
    sizes = [r[0][0] for r in embed(texts, F.col("text"), provider).select("vector").collect()]
    assert sorted(sizes) == [50.0] * 50 + [100.0] * 200


def test_texts_of_a_batch_become_objects_slice_by_slice(spark):
    class Watching(em.HashProvider):
        """Answers with the number of Python texts of this test that the worker holds."""

        def embed(self, texts):
            import gc
            alive = sum(sum(type(x) is str and x.startswith("watched ") for x in held)
                        for held in gc.get_objects() if type(held) is list and len(held) > 100)
            return [[float(alive)] for _ in texts]

    texts = spark.range(0, 4000, 1, 1).select(F.concat(F.lit("watched "), "id").alias("text"))
    most = embed(texts, F.col("text"), Watching(1)).agg(F.max(F.get("vector", F.lit(0)))).first()[0]
    assert 0 < most <= 2 * 512


def test_usage_counts_every_request_once(spark):
    class Charging(CountingService):
        def call(self, path, body=None, **_):
            return {**super().call(path, body), "usage": {"total_tokens": 1000 + len(body["input"])}}

    provider = em.HostedProvider("text-embedding-3-small", "k", transport=Charging(), per_minute=None)
    texts = spark.range(0, 250, 1, 1).select(F.col("id").cast("string").alias("text"))
    assert reports.token_usage(embed(texts, F.col("text"), provider)).first()[0] == 3 * 1000 + 250


def test_health_of_real_providers():
    assert health.check_health(em.HashProvider(8)) == health.HealthStatus(True, True, "Ollama ready")
    hosted = em.HostedProvider("text-embedding-3-small", "k", transport=FakeTransport(
        models={"data": [{"id": "text-embedding-3-small"}]}))
    assert health.check_health(hosted).model_installed


def test_hosted_provider_sorts_slices_and_counts_tokens():
    def reply(body):
        rows = [{"index": i, "embedding": [float(len(t))]} for i, t in enumerate(body["input"])]
        return {"data": rows[::-1], "usage": {"total_tokens": len(rows)}}

    transport = FakeTransport(embeddings=reply, models={"data": [{"id": "text-embedding-3-small"}]})
    provider = em.HostedProvider("text-embedding-3-small", "key", transport=transport)
    texts = ["x" * (i % 7) for i in range(250)]
    assert provider.embed(texts) == [[float(len(t))] for t in texts]
    assert [len(b["input"]) for _, b in transport.sent] == [100, 100, 50] and provider.tokens_used == 250
    assert provider.is_model_available()


@pytest.mark.parametrize("failure,local,hosted", [
    (HttpFailure(code="ETIMEDOUT"), "Request to Ollama timed out", "Request to OpenAI timed out"),
    (HttpFailure(status=401, reason="no"), "Ollama error: 401 no", "Invalid OpenAI API key. Please check your configuration."),
    (HttpFailure(status=429, reason="r"), "Ollama error: 429 r", "OpenAI rate limit exceeded. Please try again later."),
    (HttpFailure(status=500, reason="r"), "Ollama error: 500 r", "OpenAI server error. Please try again later."),
    (HttpFailure(status=400, reason="r", body={"error": {"message": "m"}}), "Ollama error: 400 r", "OpenAI error: m"),
    (HttpFailure(status=404, reason="r"), "Ollama error: 404 r", "OpenAI error: 404 r"),
    (ValueError("v"), "v", "v"),
])
def test_error_texts(failure, local, hosted):
    assert str(local_error(failure)) == local and str(hosted_error(failure)) == hosted


def test_request_budget():
    now, slept = [0.0], []
    budget = RequestBudget(2, clock=lambda: now[0], sleep=slept.append)
    budget.acquire()
    budget.acquire()
    assert not budget.can_request()
    budget.acquire()
    assert slept == [60.0]
    now[0] += 60
    assert budget.can_request()


def test_provider_choice():
    assert isinstance(em.create_provider(Settings(embedding_provider="hash")), em.HashProvider)
    assert em.create_provider(Settings(embedding_provider="openai")).name == "ollama"
    assert em.create_provider(Settings(embedding_provider="openai"), "key").name == "openai"
    assert not ex.create_expander(Settings(enable_query_expansion=True, query_expansion_provider="openai")).enabled
    assert not ex.create_expander(Settings()).enabled
    assert ex.create_expander(Settings(enable_query_expansion=True)).provider_name == "ollama"


def test_expander_memo_is_first_in_first_out():
    class Provider:
        name, calls = "p", 0

        def expand(self, query, **_):
            self.calls += 1
            return ex.ExpansionResult(query, ["s"], ["r"])

    provider = Provider()
    expander = ex.QueryExpander(provider, cache_size=2)
    assert expander.expand("A") == "A s r" and expander.detailed(" a ").cached and provider.calls == 1
    expander.expand("b")
    expander.expand("a")
    expander.expand("c")
    assert not expander.detailed("a").cached and ex.QueryExpander().expand("q") == "q"


def test_expansion_services():
    local = ex.LocalServerExpansion("m", transport=FakeTransport(api_generate={"response": 'ok {"synonyms": ["x"]}'}))
    options = {"synonyms": 3, "related": 2, "hint": "h", "timeout": 1}
    assert local.expand("q", **options).expanded_query == "q x"
    broken = ex.LocalServerExpansion("m", transport=FakeTransport(api_generate=HttpFailure(status=500)))
    assert broken.expand("q", **options) == ex.ExpansionResult("q")
    hosted = ex.HostedExpansion("m", "k", transport=FakeTransport(chat_completions={
        "choices": [{"message": {"content": '{"related": ["y"]}'}}], "usage": {"total_tokens": 9}}))
    got = hosted.expand("q", **options)
    assert got.related_terms == ["y"] and got.tokens_used == 9


def test_health():
    class Server:
        name = "ollama"

        def __init__(self, up, model):
            self.up, self.model = up, model

        def check_connection(self):
            return self.up

        def is_model_available(self, name):
            return self.model

    assert health.check_health(Server(False, False)).message == "Ollama is not running"
    assert health.check_health(Server(True, False)).message == "Model not installed"
    assert health.check_health(Server(True, True)) == health.HealthStatus(True, True, "Ollama ready")
    seen = []
    poller = health.HealthPoller(Server(True, True), 0, seen.append)
    poller.start()
    poller.stop()
    assert len(seen) == 1


cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Picky(em.HashProvider):
    """Fails on texts with 'bad' in them."""

    def embed(self, texts):
        if any("bad" in t for t in texts):
            raise ValueError("bad text")
        return super().embed(texts)


def test_embedding_isolates_bad_texts_and_retries_them(spark):
    df = spark.createDataFrame([(str(i), "bad" if i % 5 == 0 else f"word {i}") for i in range(20)], "id string, text string")
    done = embed(df, F.col("text"), Picky(8), tries=0)
    rows = {r.id: r for r in done.collect()}
    assert all((r.embed_error == "bad text") == (r.text == "bad") for r in rows.values())
    assert all(len(r.vector) == (0 if r.text == "bad" else 8) for r in rows.values())
    assert tuple(batching.embedding_counts(done).first()) == (16, 4)
    fixed = retry_failed(done, F.col("text"), em.HashProvider(8))
    assert batching.embedding_counts(fixed).first().failure_count == 0


def test_global_index_with_gaps_and_skewed_keys(spark):
    keys = [1, 2, 3, 1000, 10 ** 12] + list(range(5000, 5200))
    df = spark.createDataFrame([(k,) for k in keys], "k bigint").repartition(7)
    got = {r.k: r.position for r in batching.global_index(df, "k", rows_per_slice=40).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_settings_bounds():
    with pytest.raises(ValueError):
        Settings(min_similarity=1.5)
    with pytest.raises(ValueError):
        Settings().with_values(nothing=1)
    assert Settings().with_values(batch_size=10).batch_size == 10
