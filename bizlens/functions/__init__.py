from .numeric import money, rnd, ratio, ratio0, half_even, js_round  # noqa: F401
