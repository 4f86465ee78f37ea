import numpy as np
import pytest

from umbra.llm import lmscore


def test_short_texts_give_targets(spark):
    """No text has more tokens than its first token's number, 2 to 11."""
    texts = [f"x{i} {last}" for i in range(10) for last in "aabb"]
    net = lmscore.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert np.abs(net.top).sum() > 0


def some_network(rng):
    counts = rng.integers(0, 50, 1 << lmscore.BITS).astype(float)
    net = lmscore.Network.fresh(counts)
    for f in net.FIELDS:
        x = getattr(net, f)
        x += rng.normal(0, 0.3, x.shape).astype(np.float32)
    net.into[-1] = 0
    return net


def plain_log_likelihood(net, words):
    """Every word's probability by its definition, in double precision."""
    total = 0.0
    tokens = [int(net.token[w]) for w in words]
    for i, w in enumerate(words):
        h = np.zeros(lmscore.WIDTH)
        for k, d in enumerate([*range(-lmscore.WINDOW, 0), *range(1, lmscore.WINDOW + 1)]):
            if 0 <= i + d < len(words):
                h += net.into[tokens[i + d]].astype(float) * net.side[k]
        h = np.tanh(h)
        c, j = divmod(tokens[i], lmscore.SIZE)
        for weights, bias, own in ((net.top, net.top_bias, c), (net.low[c], net.low_bias[c], j)):
            logits = weights.astype(float) @ h + bias
            total += logits[own] - np.log(np.exp(logits).sum())
        total += float(net.within[w])
    return total


def test_scores_are_sums_of_conditional_log_probabilities():
    rng = np.random.default_rng(3)
    net = some_network(rng)
    texts = [rng.integers(0, 1 << lmscore.BITS, n).astype(np.uint16) for n in (0, 1, 2, 7, 60, 0, 9000, 5)]
    got = net.log_likelihoods(texts)
    for x, y in zip(texts, got, strict=True):
        assert y == pytest.approx(plain_log_likelihood(net, x), rel=1e-4, abs=1e-3)


def test_shares_of_a_shared_token_add_up():
    net = some_network(np.random.default_rng(4))
    sums = np.bincount(net.token, weights=np.exp(net.within.astype(float)), minlength=lmscore.VOCABULARY)
    own = lmscore.VOCABULARY - lmscore.TAIL
    assert sums[own:] == pytest.approx(1, rel=1e-4)
    assert (np.bincount(net.token)[:own] == 1).all()


def test_a_step_goes_up_the_slope():
    rng = np.random.default_rng(5)
    net = some_network(rng)
    words = rng.integers(0, 300, 500).astype(np.uint16)
    before = net.log_likelihoods([words])[0]
    squares = {f: np.zeros_like(getattr(net, f)) for f in net.FIELDS}
    for _ in range(5):
        net.train(net.pad(net.token[words]), np.arange(len(words)), squares)
    assert net.log_likelihoods([words])[0] > before + 100


def test_layout_does_not_matter(spark):
    """Also a very long text, a null, an empty text, repeated rows and a table without rows."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 80) % 500) for _ in range(60)] + ["long " * 60_000, None, "", "again and again", "again and again"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, words string")
    nets = [lmscore.fit(d, shard_words=2000, fan_in=4) for d in (df.repartition(2), df.repartition(7, "text"))]
    for f in ("token", "within", *lmscore.Network.FIELDS):
        assert (getattr(nets[0], f) == getattr(nets[1], f)).all()
    rows = {r["doc_id"]: r for r in lmscore.score(df, nets[0]).collect()}
    assert len(rows) == 65
    assert rows[63]["log_likelihood"] == pytest.approx(rows[64]["log_likelihood"], rel=1e-5)
    assert (rows[60]["n_tokens"], rows[61]["n_tokens"], rows[61]["log_likelihood"], rows[62]["mean_log_likelihood"]) == (60_000, 0, 0.0, None)
    assert lmscore.score(df.limit(0), lmscore.fit(df.limit(0))).collect() == []
