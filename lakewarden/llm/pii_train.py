"""Training of the personal-information tagger with numpy: ``python -m lakewarden.llm.pii_train TABLE_DIR [OUT [SECONDS [FIRST]]]``.

Two sources of labelled spans: texts composed by ``pii_forms`` (exact spans, new spellings in every text), and texts of ``candidates`` and
``query_responses`` labelled weakly by ``pii_labels``, also with their spans exchanged for composed ones, so that new forms meet real contexts; windows
with an unsure name are left out. A second run, from the weights of a first one, also knows the given names that one discovered in the texts. Bounds: MOST_TEXTS real texts, COMPOSED texts, EPOCHS passes. One window in twenty is held out and scored at the end.
Each step's batch is shared by WORKERS processes that send their gradients back.
"""

from __future__ import annotations

import multiprocessing
import os
import re
import sys
import time
from collections import Counter

import numpy as np
import xxhash

from lakewarden.llm import pii, pii_forms, pii_labels

MOST_TEXTS, COMPOSED, EPOCHS, WORKERS = 20_000, 130_000, 8, 8
HIDDEN, EMBED, LENGTH, BATCH, RATE = 40, 24, 128, 48, 6e-3
TAGS = len(pii.KINDS) + 1


def common_words(texts: list[str]) -> set[str]:
    """Words that occur in lower case in several texts, or in one text of fifty in any case: no names."""
    low, any_case = Counter(), Counter()
    for t in texts:
        w = set(re.findall(r"(?<![\w@.])[^\W\d_]+(?![\w@]|\.\w)", t))  # parts of mail addresses are no words
        if not t.islower():  # in a text without capitals a name is no common word
            low.update(x for x in w if x.islower())
        any_case.update({x.lower() for x in w})
    return {w for w, n in low.items() if n >= len(texts) * 4e-4} | {w for w, n in any_case.items() if n >= len(texts) * 2e-2}


def exchanged(text: str, spans: list, unsure: list, forms: pii_forms.Forms) -> tuple[str, list, list]:
    """The text with each span replaced by a composed one of its kind, and the places of all spans."""
    parts, new, doubt, at, length = [], [], [], 0, 0
    lang = forms.of(pii_forms.LANGS)
    for lo, hi, kind in sorted([*spans, *((lo, hi, None) for lo, hi in unsure)]):
        other = text[lo:hi] if kind is None else getattr(forms, kind)(lang)
        if kind == "id_number" and other.isdigit():
            other = text[lo:hi]
        parts += [text[at:lo], other]
        length += lo - at
        (doubt if kind is None else new).append((length, length + len(other), kind))
        length += len(other)
        at = hi
    return "".join(parts) + text[at:], new, [x[:2] for x in doubt]


def windows(text: str, spans: list, unsure: list, xs: list, ys: list, rng: np.random.Generator, keep: float = 1.0) -> None:
    """Add the windows of a text's stretches; those without a span with a chance of ``keep``."""
    code = pii.codes(text)
    tags = np.zeros(len(code), np.int8)
    for lo, hi, kind in spans:
        tags[lo:hi] = pii.KINDS.index(kind) + 1
    for lo, hi in unsure:
        tags[lo:hi] = -1
    for lo, hi in pii.stretches(text):
        for at in range(lo, hi, LENGTH - 32):
            if at > lo and hi - at <= 32:
                break
            y = tags[at : min(hi, at + LENGTH)]
            if (y < 0).any() or (not y.any() and rng.random() > keep):
                continue
            xs.append(pii.SYMBOL[code[at : min(hi, at + LENGTH)]].astype(np.int16))
            ys.append(y)


def discovered(texts: list[str], common: set[str], weights: str, least: int = 3, share: float = 0.25) -> frozenset[str]:
    """Given names a first model finds in the texts: words that begin ``least`` unsure names and are part of a find in ``share`` of them."""
    tagger, there, found = pii.Tagger(weights), Counter(), Counter()
    for at in range(0, len(texts), 1000):
        part = texts[at : at + 1000]
        for t, tagged in zip(part, tagger.tag(part)):
            for lo, hi in pii_labels.label(t, common)[1]:
                words = re.findall(r"[^\W\d_]+", t[lo:hi])
                first = pii_labels._bare(words[-1] if "," in t[lo:hi] else words[0])
                there[first] += 1
                found[first] += any(k == "person_name" and 2 * (min(b, hi) - max(a, lo)) > hi - lo for a, b, k in tagged)
    return frozenset(w for w, n in there.items() if n >= least and found[w] >= share * n)


def samples(texts: list[str], rng: np.random.Generator, first: str | None = None):
    xs: list = []
    ys: list = []
    forms = pii_forms.Forms(rng)
    common = common_words(texts)
    fillers: list[str] = []
    known = discovered(texts, common, first) if first else frozenset()
    for t in texts:
        spans, unsure = pii_labels.label(t, common, known)
        windows(t, spans, unsure, xs, ys, rng, keep=0.35)
        if spans:
            windows(t, spans, unsure, xs, ys, rng, keep=0.1)
            for _ in range(3):
                windows(*exchanged(t, spans, unsure, forms), xs, ys, rng, keep=0.1)
        elif not unsure and len(fillers) < 20_000:
            fillers += [x for x in re.split(r"(?<=[.!?])\s+", t) if 10 < len(x) < 200][:4]
    forms.plain = sorted(w for w in common if len(w) > 2 and w not in pii_labels.GIVEN)
    for _ in range(COMPOSED):
        t, spans = pii_forms.composed(forms, list(pii.KINDS), fillers)
        windows(t, spans, [], xs, ys, rng)
    return xs, ys


def sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


def lstm_forward(e, w, d):
    """e: (steps, n, EMBED) -> states and what the backward pass needs."""
    steps, n, _ = e.shape
    gx = e @ w[f"Wx_{d}"] + w[f"b_{d}"]
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    hs, cs, zs = np.empty((steps + 1, n, HIDDEN), np.float32), np.empty((steps + 1, n, HIDDEN), np.float32), np.empty((steps, n, 4 * HIDDEN), np.float32)
    hs[0], cs[0] = h, c
    k = HIDDEN
    for t in range(steps):
        z = gx[t] + h @ w[f"Wh_{d}"]
        z[:, : 3 * k] = sigmoid(z[:, : 3 * k])
        z[:, 3 * k :] = np.tanh(z[:, 3 * k :])
        c = c * z[:, k : 2 * k] + z[:, :k] * z[:, 3 * k :]
        h = np.tanh(c) * z[:, 2 * k : 3 * k]
        hs[t + 1], cs[t + 1], zs[t] = h, c, z
    return hs, cs, zs


def lstm_backward(dh_all, e, saved, w, d, grads):
    hs, cs, zs = saved
    steps, n, k = dh_all.shape
    dz_all = np.empty_like(zs)
    dh, dc = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
    for t in range(steps - 1, -1, -1):
        z = zs[t]
        i, f, o, g = z[:, :k], z[:, k : 2 * k], z[:, 2 * k : 3 * k], z[:, 3 * k :]
        dh = dh + dh_all[t]
        tc = np.tanh(cs[t + 1])
        dc = dc + dh * o * (1 - tc * tc)
        dz = dz_all[t]
        dz[:, :k] = dc * g * i * (1 - i)
        dz[:, k : 2 * k] = dc * cs[t] * f * (1 - f)
        dz[:, 2 * k : 3 * k] = dh * tc * o * (1 - o)
        dz[:, 3 * k :] = dc * i * (1 - g * g)
        dc = dc * f
        dh = dz @ w[f"Wh_{d}"].T
    flat = dz_all.reshape(-1, 4 * k)
    grads[f"Wh_{d}"] = hs[:-1].reshape(-1, k).T @ flat
    grads[f"Wx_{d}"] = e.reshape(-1, e.shape[2]).T @ flat
    grads[f"b_{d}"] = flat.sum(0)
    return dz_all @ w[f"Wx_{d}"].T


def logsum(x, axis):
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def crf(em, tags, mask, trans, start):
    """Negative log-likelihood of a batch and its gradients; em: (steps, n, TAGS)."""
    steps, n, _ = em.shape
    alpha, beta = np.empty_like(em), np.empty_like(em)
    alpha[0] = em[0] + start
    for t in range(1, steps):
        a = logsum(alpha[t - 1][:, :, None] + trans, 1) + em[t]
        alpha[t] = np.where(mask[t][:, None], a, alpha[t - 1])
    z = logsum(alpha[-1], 1)
    beta[-1] = 0
    for t in range(steps - 2, -1, -1):
        b = logsum(trans + (em[t + 1] + beta[t + 1])[:, None, :], 2)
        beta[t] = np.where(mask[t + 1][:, None], b, beta[t + 1])
    p = np.exp(alpha + beta - z[None, :, None]) * mask[:, :, None]
    gold = np.zeros_like(em)
    np.put_along_axis(gold, tags[:, :, None], 1, 2)
    gold *= mask[:, :, None]
    dtrans = np.zeros_like(trans)
    for t in range(1, steps):
        pair = np.exp(alpha[t - 1][:, :, None] + trans + (em[t] + beta[t])[:, None, :] - z[:, None, None]) * mask[t][:, None, None]
        dtrans += pair.sum(0)
    right = mask[1:].astype(bool)
    np.add.at(dtrans, (tags[:-1][right], tags[1:][right]), -1)
    seq = (em * gold).sum((0, 2)) + start[tags[0]] + (trans[tags[:-1], tags[1:]] * mask[1:]).sum(0)
    return float((z - seq).mean()), (p - gold) / n, dtrans / n, (p[0] - gold[0]).sum(0) / n


def gradients(w: dict, x: np.ndarray, y: np.ndarray, mask: np.ndarray, back: np.ndarray) -> tuple[float, dict]:
    xb = np.take_along_axis(x, back, 0)
    ef, eb = w["E"][x], w["E"][xb]
    sf, sb = lstm_forward(ef, w, "f"), lstm_forward(eb, w, "b")
    hb = np.take_along_axis(sb[0][1:], back[:, :, None], 0)
    both = np.concatenate([sf[0][1:], hb], 2)
    em = both @ w["Wo"] + w["bo"]
    loss, dem, dtrans, dstart = crf(em, y, mask, w["trans"], w["start"])
    g = {"trans": dtrans, "start": dstart, "Wo": both.reshape(-1, 2 * HIDDEN).T @ dem.reshape(-1, TAGS), "bo": dem.sum((0, 1))}
    dboth = dem @ w["Wo"].T
    de_f = lstm_backward(dboth[:, :, :HIDDEN], ef, sf, w, "f", g)
    de_b = lstm_backward(np.take_along_axis(dboth[:, :, HIDDEN:], back[:, :, None], 0), eb, sb, w, "b", g)
    ge = np.zeros_like(w["E"])
    flat = np.concatenate([x.ravel(), xb.ravel()])
    values = np.concatenate([de_f.reshape(-1, EMBED), de_b.reshape(-1, EMBED)])
    by = np.argsort(flat, kind="stable")
    ids, first = np.unique(flat[by], return_index=True)
    ge[ids] = np.add.reduceat(values[by], first, axis=0)
    g["E"] = ge
    return loss, g


def load(xs: list, ys: list, ids: np.ndarray):
    steps = max(len(xs[i]) for i in ids)
    x, y, mask = np.zeros((steps, len(ids)), np.int64), np.zeros((steps, len(ids)), np.int64), np.zeros((steps, len(ids)), np.float32)
    back = np.zeros((steps, len(ids)), np.int64)
    for j, i in enumerate(ids):
        n = len(xs[i])
        x[:n, j], y[:n, j], mask[:n, j] = xs[i], ys[i], 1
        back[:, j] = np.concatenate([np.arange(n)[::-1], np.arange(n, steps)])
    return x, y, mask, back


def worker(pipe, xs: list, ys: list) -> None:
    while (job := pipe.recv()) is not None:
        w, ids = job
        pipe.send(gradients(w, *load(xs, ys, ids)))


def train(texts: list[str], out: str = pii.WEIGHTS, seed: int = 3, epochs: int = EPOCHS, seconds: float = 1e9, first: str | None = None, report=print) -> None:
    """Train and write the weights; ends early, with the rate run down, when ``seconds`` are over.

    With the weights of a ``first`` model training goes on from them, and given names it discovers in the real texts count as known.
    """
    rng = np.random.default_rng(seed)
    texts = sorted(set(texts), key=xxhash.xxh3_64_intdigest)[:MOST_TEXTS]
    xs, ys = samples(texts, rng, first)
    cut = len(xs) // 20
    order = rng.permutation(len(xs))
    held, used = order[:cut], order[cut:]
    init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    w = {"E": init(pii.SYMBOLS, EMBED) * 6}
    for d in "fb":
        w |= {f"Wx_{d}": init(EMBED, 4 * HIDDEN), f"Wh_{d}": init(HIDDEN, 4 * HIDDEN), f"b_{d}": np.zeros(4 * HIDDEN, np.float32)}
        w[f"b_{d}"][HIDDEN : 2 * HIDDEN] = 1
    w |= {"Wo": init(2 * HIDDEN, TAGS), "bo": np.array([2.0] + [0.0] * (TAGS - 1), np.float32), "trans": np.zeros((TAGS, TAGS), np.float32), "start": np.zeros(TAGS, np.float32)}
    if first:
        with np.load(first) as z:
            w = {k: z[k].astype(np.float32) for k in w}
    m, v = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}
    used = np.array(sorted(used, key=lambda i: len(xs[i])))
    batches = [used[i : i + BATCH] for i in range(0, len(used), BATCH)]
    report(f"{len(texts)} texts, {len(xs)} windows, {len(batches)} batches")
    context = multiprocessing.get_context("fork")
    team = []
    for _ in range(WORKERS):
        mine, theirs = context.Pipe()
        process = context.Process(target=worker, args=(theirs, xs, ys), daemon=True)
        process.start()
        team.append((mine, process))
    step, began = 0, time.time()
    total = epochs * (len(batches) // WORKERS)
    for epoch in range(epochs):
        losses, turn = [], rng.permutation(len(batches))
        for at in range(0, len(batches) - WORKERS + 1, WORKERS):
            for (pipe, _), b in zip(team, turn[at : at + WORKERS]):
                pipe.send((w, batches[b]))
            answers = [pipe.recv() for pipe, _ in team]
            losses += [x for x, _ in answers]
            g = {k: sum(a[k] for _, a in answers) / WORKERS for k in w}
            step += 1
            done = max(step / total, (time.time() - began) / seconds)
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            scale = min(1.0, 5.0 / (norm + 1e-9))
            rate = RATE * min(1, step / 60) * 0.5 * (1 + np.cos(np.pi * min(done, 1)))
            for k, x in g.items():
                x = x * scale
                m[k] += 0.1 * (x - m[k])
                v[k] += 0.003 * (x * x - v[k])
                w[k] = w[k] - (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.997**step)) + 1e-8)).astype(np.float32)
            if done >= 1:
                break
        report(f"epoch {epoch}: loss {np.mean(losses):.4f}, {time.time() - began:.0f} s")
        if done >= 1:
            break
    for pipe, process in team:
        pipe.send(None)
        process.join()
    np.savez_compressed(out, **{k: x.astype(np.float16) if k != "trans" else x for k, x in w.items()})
    tagger = pii.Tagger(out)
    right = Counter()
    for i, e in zip(held, tagger.scores([xs[i] for i in held])):
        tags = tagger.decode([e])[0]
        for k in range(1, TAGS):
            right[k, "both"] += int(((tags == k) & (ys[i] == k)).sum())
            right[k, "found"] += int((tags == k).sum())
            right[k, "there"] += int((ys[i] == k).sum())
    for k in range(1, TAGS):
        report(f"held out, {pii.KINDS[k - 1]}: precision {right[k, 'both'] / max(1, right[k, 'found']):.4f}, recall {right[k, 'both'] / max(1, right[k, 'there']):.4f}")


def main(folder: str, out: str = pii.WEIGHTS, seconds: str = "1e9", first: str | None = None) -> None:
    import pyarrow.parquet as pq

    texts = []
    for name, column in (("candidates", "content"), ("query_responses", "answer")):
        texts += [t for t in pq.read_table(f"{folder}/{name}.parquet", columns=[column])[column].to_pylist() if t]
    train(texts, out, seconds=float(seconds), first=first)


if __name__ == "__main__":
    for variable in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):  # each worker is one thread
        if os.environ.get(variable) != "1":
            os.environ[variable] = "1"
            os.execv(sys.executable, [sys.executable, "-m", "lakewarden.llm.pii_train", *sys.argv[1:]])
    main(*sys.argv[1:])
