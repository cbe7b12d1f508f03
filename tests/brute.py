"""Plain one-window versions of the operators, straight from their definitions."""

import numpy as np


def cosine(a, b):
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    na[na == 0], nb[nb == 0] = 1, 1
    return 1 - (a / na[:, None]) @ (b / nb[:, None]).T


def dbscan(x, eps, size):
    d = cosine(x, x)
    np.fill_diagonal(d, 0)
    near = d <= eps
    core = near.sum(1) >= size
    label = np.full(len(x), -1)
    c = 0
    for i in range(len(x)):
        if not core[i] or label[i] >= 0:
            continue
        stack = [i]
        label[i] = c
        while stack:
            for j in np.flatnonzero(near[stack.pop()]):
                if label[j] < 0:
                    label[j] = c
                    if core[j]:
                        stack.append(j)
        c += 1
    return label


def silhouette(x, label):
    """Per-row scores of the rows that are no noise; None with fewer than two clusters."""
    keep = label != -1
    x, label = x[keep], label[keep]
    names = np.unique(label)
    if len(names) < 2:
        return None
    d = cosine(x, x)
    np.fill_diagonal(d, 0)
    s = []
    for i in range(len(x)):
        own = label == label[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = d[i][own].sum() / (own.sum() - 1)
        b = min(d[i][label == o].mean() for o in names if o != label[i])
        s.append((b - a) / max(a, b))
    return label, np.array(s)


def window(t, at, span, gap):
    return ((t > at - span) & (t <= at - gap)) | (t == at)


def features(x, label, f, own, returns):
    """Own-cluster and total statistics of one window, ``own`` being the anchor's row."""
    mine = label == label[own]
    out = {"nb_news": mine.sum(), "nb_news_tot": len(x), "nb_cluster_tot": len(np.unique(label))}
    sil = silhouette(x, label)
    if sil is not None:
        lab, s = sil
        out["silhouette_score_tot"] = s.mean()
        out["silhouette_score"] = s[lab == label[own]].mean() if label[own] != -1 else None
    else:
        out["silhouette_score_tot"] = out["silhouette_score"] = None
    centre = x[mine].mean(0)
    d = cosine(x[mine], centre[None, :])[:, 0]
    out["mean_dist"], out["std_dist"] = d.mean(), d.std()
    for k, c in enumerate(centre):
        out[f"emb_{k + 1}"] = c
    bad = any(np.isnan(v).any() for n, v in f.items() if n in returns)
    for n, v in f.items():
        for suffix, w in (("", v[mine]), ("_tot", v)):
            w = w[~np.isnan(w)]
            out[f"{n}_mean{suffix}"] = w.mean() if len(w) else None
            std = w.std(ddof=1) if len(w) > 1 else None
            out[f"{n}_std{suffix}"] = None if n in returns and bad else std
    return out


def chain(x, t, start, labels, span, gap, last, eps, size):
    """Labels of the rows after a fit, one by one in time. ``labels`` of the fit by row."""
    known = dict(labels)
    for i in np.argsort(t):
        if i in known or not (start - gap < t[i] <= last):
            continue
        votes = {}
        for j, lab in known.items():
            if lab != -1 and t[j] < t[i] and window(t[j : j + 1], t[i], span, gap)[0]:
                if cosine(x[i : i + 1], x[j : j + 1])[0, 0] < eps:
                    votes[lab] = votes.get(lab, 0) + 1
        best = min(votes, key=lambda k: (-votes[k], k)) if votes else -1
        known[i] = best if votes and votes[best] > size else -1
    return known
