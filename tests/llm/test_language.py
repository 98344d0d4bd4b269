"""The byte network against a plain convolution and plain derivatives."""

import numpy as np

from pairtide.llm.language import ByteNet, LanguageSpec

SPEC = LanguageSpec(filters=5, size=3, steps=1, batch=4)


def plain(net: ByteNet, window) -> np.ndarray:
    """Chances of one window, one filter position after another."""
    w, spec, pooled = net.weights, net.spec, []
    for width in spec.widths:
        for f in range(spec.filters):
            answers = []
            for start in range(len(window) - width + 1):
                total = float(w[f"bias{width}"][f])
                for k in range(width):
                    for d in range(spec.size):
                        total += float(w["embed"][window[start + k], d]) * float(w[f"filter{width}"][k * spec.size + d, f])
                answers.append(total)
            pooled.append(max(max(answers), 0.0))
    logits = np.array(pooled) @ w["out"].astype(float) + w["level"]
    chance = np.exp(logits - logits.max())
    return chance / chance.sum()


def test_pair_tables_are_the_convolution():
    rng = np.random.default_rng(8)
    net = ByteNet(["a", "b", "c"], SPEC)
    for width in SPEC.widths:
        net.weights[f"bias{width}"] = rng.normal(0, 0.3, SPEC.filters).astype(np.float32)
    windows = rng.integers(0, 256, (6, 24)).astype(np.uint8)
    windows[0, 10:] = 0  # a short text
    windows[1] = 0  # an empty one
    windows[2] = 255
    got = net.predict(windows, net.tables())
    assert np.allclose(got, [plain(net, row) for row in windows], atol=1e-5)
    assert np.allclose(got.sum(axis=1), 1)


def test_a_step_goes_down_every_slope():
    """The first step of Adam moves a weight against the sign of its derivative, taken here by differences."""
    rng = np.random.default_rng(2)
    windows, targets = rng.integers(1, 256, (1, 12)).astype(np.uint8), np.array([1])
    before, after = ByteNet(["a", "b"], SPEC), ByteNet(["a", "b"], SPEC).fit(windows, targets)
    checked = 0
    for name, values in before.weights.items():
        flat = values.reshape(-1)
        moved = (after.weights[name] - values).reshape(-1)
        if name == "embed":
            spots = [int(b) * SPEC.size + d for b in windows[0][:4] for d in range(SPEC.size)]
        else:
            spots = rng.permutation(len(flat))[:12].tolist()
        for i in spots:
            kept, loss = flat[i], []
            for nudge in (-1e-2, 1e-2):
                flat[i] = kept + nudge
                loss.append(-np.log(plain(before, windows[0])[1]))
            flat[i] = kept
            slope = (loss[1] - loss[0]) / 2e-2
            if abs(slope) > 1e-3:
                assert moved[i] * slope < 0, (name, i)
                checked += 1
    assert checked > 20
