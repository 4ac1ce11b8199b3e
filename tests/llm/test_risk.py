"""The classifier's risk where the negative part is above 0 and where it is below."""

import numpy as np
import pytest

from kinstrata.llm import quality


def test_risk_of_either_sign():
    loss = lambda z: np.log(1 + np.exp(-z))
    fp, fu = np.array([0.0, 2.0]), np.array([3.0, 1.0])
    positive = 0.6 * (loss(0.0) + loss(2.0)) / 2
    negative = (loss(-3.0) + loss(-1.0)) / 2 - 0.6 * (loss(0.0) + loss(-2.0)) / 2
    assert negative > 0 and quality.risk(fp, fu, 0.6) == pytest.approx((positive + negative, negative))
    risk, below = quality.risk(fp, np.array([-1.0, 1.0, 0.0]), 0.6)
    assert below == pytest.approx(-0.07279903894874507) and risk == pytest.approx(positive)
