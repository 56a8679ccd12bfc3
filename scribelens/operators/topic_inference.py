"""Variational inference of the topics of a document, as `pyspark.ml` does it."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

GAMMA_SHAPE = 100.0  # of the weights from which `pyspark.ml` starts
NEGLIGIBLE = 1e-130  # see `Inference`
DRAWN = 1 << 16  # weights drawn at once
ENOUGH = 1e-3  # mean change of ``gamma`` that ends inference
NARROW = 48  # topics of a document that goes on together with others, at most
TOGETHER = 1 << 18  # weights by term and topic of such documents
HELD = 1 << 22  # such weights that wait
ROWS = 256  # terms whose weights are computed at once


def digamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers: six steps up, then the asymptotic series."""
    pairs, twice, far = x * (x + 5.0), 2.0 * x + 5.0, x + 6.0
    steps = twice / pairs + twice / (pairs + 4.0) + twice / (pairs + 6.0)
    r = 1.0 / (far * far)
    series = 0.0
    for c in (1 / 12, -691 / 32760, 1 / 132, -1 / 240, 1 / 252, -1 / 120, 1 / 12):
        series = r * (c + series)
    return np.log(far) - 0.5 / far - series - steps


def digamma_of_fit(x: np.ndarray) -> np.ndarray:
    """As the fit of `pyspark.ml` has it: one term of its series, which begins at 49, has the other sign."""
    far = x + np.maximum(np.ceil(49.0 - x), 0.0)
    far *= far
    return digamma(x) - 1.0 / (60.0 * far * far)


def draws(spark, seed: int, count: int) -> np.ndarray:
    """The first weights that `pyspark.ml` draws with a seed."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    # A seed below 2^31 would be taken for a 32-bit one, so its halves are given, as the generator splits a long.
    halves = gateway.new_array(jvm.int, 2)
    halves[0], halves[1] = (int(h) for h in np.array([seed >> 32, seed & 0xFFFFFFFF], np.int64).astype(np.int32))
    random = jvm.breeze.stats.distributions.RandBasis(jvm.org.apache.commons.math3.random.MersenneTwister(halves))
    start = jvm.breeze.stats.distributions.Gamma(GAMMA_SHAPE, 1.0 / GAMMA_SHAPE, random)
    found = np.empty(count)
    for at in range(0, count, DRAWN):
        some = found[at : at + DRAWN]
        buffer = jvm.java.nio.ByteBuffer.allocate(some.nbytes)
        buffer.asDoubleBuffer().put(start.samplesVector(len(some), jvm.scala.reflect.ClassTag.Double()).toArray(jvm.scala.reflect.ClassTag.Double()))
        some[:] = np.frombuffer(buffer.array(), ">f8")
    return found


def weights_of(counts: np.ndarray, digamma=digamma) -> np.ndarray:
    """By term and topic, from a model's counts."""
    beta, whole = np.empty(counts.shape), digamma(counts.sum(axis=0))
    for at in range(0, len(counts), ROWS):
        beta[at : at + ROWS] = np.exp(digamma(counts[at : at + ROWS]) - whole)
    return beta


def inference_table(spark, model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What inference needs of a model: weights by term and topic, the prior, and the start."""
    beta = weights_of(model.topicsMatrix().toArray())
    alpha = np.array(model.estimatedDocConcentration().toArray())
    # The seed of a model's inference is not that of its fit.
    return beta, alpha, draws(spark, model._java_obj.oldLocalModel().seed(), len(alpha))


@dataclass
class Inference:
    """A document under inference: the topics that are left, and the rows of ``beta`` for them."""

    number: int
    beta: np.ndarray
    counts: np.ndarray
    left: np.ndarray
    prior: np.ndarray
    gamma: np.ndarray
    theta: np.ndarray
    rest: float = 0.0  # of the prior of those that have vanished
    change: float = np.inf

    def drop_vanished(self) -> None:
        """A term's norm is at least 1e-100, so a topic whose ``theta`` is below `NEGLIGIBLE` adds
        nothing that a double can hold, neither to a norm nor to its own prior: it keeps its prior,
        and with it a ``theta`` as small, for good. Its column is left out from then on."""
        held = (self.theta >= NEGLIGIBLE) | (self.gamma != self.prior)
        if 4 * np.count_nonzero(held) < 3 * len(held):
            self.rest += self.prior[~held].sum()
            self.gamma, self.theta, self.prior, self.left = self.gamma[held], self.theta[held], self.prior[held], self.left[held]
            self.beta = np.ascontiguousarray(self.beta[:, held])


def variational(documents: Iterable[tuple], beta: np.ndarray, alpha: np.ndarray, digamma=digamma) -> Iterator[Inference]:
    """Of documents (terms or None for all, counts, start): what is left when inference ends, in any order.

    Each document is inferred alone until it has few topics left, and from then on together with
    others, so that small steps are not lost in calls.
    """
    held, size = [], 0
    for number, (terms, counts, start) in enumerate(documents):
        own = beta if terms is None else beta[terms]
        one = Inference(number, own, counts, np.arange(len(alpha)), alpha, start, np.exp(digamma(start) - digamma(start.sum())))
        while one.change > ENOUGH and len(one.left) > NARROW:
            last = one.gamma
            one.gamma = one.theta * ((counts / (one.beta @ one.theta + 1e-100)) @ one.beta) + one.prior
            one.change = np.abs(one.gamma - last).sum() / len(alpha)
            one.theta = np.exp(digamma(one.gamma) - digamma(one.gamma.sum() + one.rest))
            one.drop_vanished()
        if one.change <= ENOUGH:
            yield one
            continue
        held.append(one)
        size += one.beta.size
        if size >= HELD:
            yield from _ended(held, len(alpha), digamma)
            held, size = [], 0
    yield from _ended(held, len(alpha), digamma)


def _ended(held: list[Inference], topics: int, digamma) -> Iterator[Inference]:
    """Documents of about as many terms go on together; those that are left meet anew."""
    while held:
        held.sort(key=lambda one: len(one.counts))
        begin = 0
        while begin < len(held):
            end, width = begin + 1, len(held[begin].left)
            while end < len(held) and (end + 1 - begin) * len(held[end].counts) * max(width, len(held[end].left)) <= TOGETHER:
                width = max(width, len(held[end].left))
                end += 1
            _go_on(held[begin:end], topics, digamma)
            begin = end
        yield from (one for one in held if one.change <= ENOUGH)
        held = [one for one in held if one.change > ENOUGH]


def _go_on(some: list[Inference], topics: int, digamma) -> None:
    """Until half of the documents are done. What pads a document's terms and topics counts as nothing."""
    terms, width = max(len(one.counts) for one in some), max(len(one.left) for one in some)
    beta, counts = np.zeros((len(some), terms, width)), np.zeros((len(some), terms))
    gamma, prior, theta, held = np.ones((len(some), width)), np.ones((len(some), width)), np.zeros((len(some), width)), np.zeros((len(some), width))
    rest = np.array([one.rest for one in some])
    for i, one in enumerate(some):
        n = len(one.left)
        beta[i, : len(one.counts), :n], counts[i, : len(one.counts)] = one.beta, one.counts
        gamma[i, :n], prior[i, :n], theta[i, :n], held[i, :n] = one.gamma, one.prior, one.theta, 1.0
    active = np.arange(len(some))
    while 2 * len(active) > len(some):
        last = gamma
        norms = np.matmul(beta, theta[:, :, None])[:, :, 0] + 1e-100
        gamma = theta * np.matmul((counts / norms)[:, None, :], beta)[:, 0] + prior
        change = np.abs(gamma - last).sum(axis=1) / topics
        expected = digamma(np.column_stack([gamma, (gamma * held).sum(axis=1) + rest]))
        theta = held * np.exp(expected[:, :-1] - expected[:, -1:])
        for i in active[change[active] <= ENOUGH]:
            _keep(some[i], gamma[i], theta[i], change[i])
        active = active[change[active] > ENOUGH]
    for i in active:
        _keep(some[i], gamma[i], theta[i], change[i])
        some[i].drop_vanished()


def _keep(one: Inference, gamma: np.ndarray, theta: np.ndarray, change: float) -> None:
    n = len(one.left)
    one.gamma, one.theta, one.change = gamma[:n].copy(), theta[:n].copy(), float(change)


def inferred(documents: list[tuple], beta: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Topic weights of documents, a row each; those of one without counts are 0."""
    found = np.zeros((len(documents), len(alpha)))
    some = [i for i, (_, counts, _) in enumerate(documents) if counts.any()]
    for one in variational((documents[i] for i in some), beta, alpha):
        row = found[some[one.number]]
        row[:] = alpha
        row[one.left] = one.gamma
        row /= row.sum()
    return found
