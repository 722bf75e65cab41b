def area_under_curve(labels, scores) -> float:
    ranks = scores.rank()
    good, bad = (labels == 1).sum(), (labels == 0).sum()
    return (ranks[labels == 1].sum() - good * (good + 1) / 2) / (good * bad)
