"""The learned scores against plain formulas: risk and gradient of the toxicity model, densities of the quality model."""

import numpy as np

from lodestone.llm import quality, toxicity


def test_toxicity_follows_the_gradient_of_its_risk():
    """The same steps with a gradient taken by differences of the risk as it is defined."""
    rng = np.random.default_rng(1)
    positive = [np.unique(np.append(rng.choice(8, 3), 100 + rng.integers(0, 3))) for _ in range(12)]
    unlabelled = [np.unique(np.append(rng.choice(8, 3), [100 + rng.integers(0, 3)] if i % 6 == 0 else [50])) for i in range(60)]
    prior = 0.2
    model = toxicity.fit(positive, unlabelled, prior)
    assert len(model.hashes)
    design = lambda sets: np.array([[float(h in s) for h in model.hashes] for s in sets])
    xp, xu, decay = design(positive), design(unlabelled), toxicity.DECAY / len(positive)
    soft = lambda g: np.log1p(np.exp(g))

    def negative(t):  # the prior-corrected risk of texts as negatives, each bounded
        gp, gu = xp @ t[:-1] + t[-1], xu @ t[:-1] + t[-1]
        return soft(np.minimum(gu, toxicity.CEILING)).mean() - prior * soft(np.minimum(gp, toxicity.CEILING)).mean()

    def risk(t, back):
        weight = decay / 2 * (t[:-1] ** 2).sum()
        return weight - negative(t) if back else weight + negative(t) + prior * soft(-(xp @ t[:-1] + t[-1])).mean()

    t = np.append(np.zeros(len(model.hashes)), np.log(prior / (1 - prior)))
    m, v, turned = np.zeros(len(t)), np.zeros(len(t)), 0
    for step in range(1, toxicity.STEPS + 1):
        back = negative(t) < -toxicity.BETA * prior
        turned += back
        grad = np.array([(risk(t + e, back) - risk(t - e, back)) / 2e-5 for e in np.eye(len(t)) * 1e-5])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        t = t - toxicity.RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    scores = [model.score(s) for s in positive + unlabelled]
    expected = 1 / (1 + np.exp(-np.append(xp @ t[:-1], xu @ t[:-1]) - t[-1]))
    assert np.abs(np.array(scores) - expected).max() < 0.05
    assert all((a >= 0.5) == (b >= 0.5) for a, b in zip(scores, expected) if abs(b - 0.5) > 0.05)


def test_quality_equals_the_densities_with_an_explicit_inverse():
    rng = np.random.default_rng(2)
    label = rng.integers(0, 2, 300)
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)) * (1 + label[:, None]) + 2 * label[:, None]
    model = quality.fit(x, label)
    z = (x - x.mean(0)) / (x.std(0) + 1e-6)
    share = np.array([(label == c).mean() for c in (0, 1)])
    own = [np.cov(z[label == c].T, bias=True) for c in (0, 1)]
    pooled = share[0] * own[0] + share[1] * own[1]
    density = []
    for c in (0, 1):
        cov = (1 - quality.POOLED) * own[c] + quality.POOLED * pooled
        cov = (1 - quality.SPHERE) * cov + quality.SPHERE * np.trace(cov) / 5 * np.eye(5)
        d = z - z[label == c].mean(0)
        square = np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d)
        density.append(share[c] * np.exp(-square / 2) / np.sqrt((2 * np.pi) ** 5 * np.linalg.det(cov)))
    assert np.allclose(model.score(x), density[1] / (density[0] + density[1]), atol=1e-9)
