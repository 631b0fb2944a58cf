"""Retries of calls with side effects. These are not Spark's task retries: a call is repeated only where asked to."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass


@dataclass(frozen=True)
class RetryPolicy:
    """At most max_attempts attempts; the wait before the n-th is initial * multiplier**(n - 2), up to max if that is set."""

    max_attempts: int = 1
    initial_backoff_seconds: float = 0.0
    max_backoff_seconds: float = 0.0
    backoff_multiplier: float = 2.0

    def __post_init__(self) -> None:
        for name, least in (("max_attempts", 1), ("initial_backoff_seconds", 0), ("max_backoff_seconds", 0), ("backoff_multiplier", 1)):
            if getattr(self, name) < least:
                raise ValueError(f"retry {name} must be >= {least}")

    def delay_before_attempt(self, attempt: int) -> float:
        if attempt < 2:
            return 0.0
        wait = self.initial_backoff_seconds * self.backoff_multiplier ** (attempt - 2)
        return min(wait, self.max_backoff_seconds) if self.max_backoff_seconds > 0 else wait

    def delays(self) -> Iterator[float]:
        """The waits before the second and later attempts."""
        return (self.delay_before_attempt(n) for n in range(2, self.max_attempts + 1))


def call(operation: Callable, policy: RetryPolicy, retryable: Callable[[Exception], bool], *, on_retry: Callable[[Exception, int, float], None] | None = None, sleep: Callable[[float], None] = time.sleep):
    """The operation's result; its last error where attempts run out or the error is not retryable."""
    waits = enumerate(policy.delays(), 2)
    while True:
        try:
            return operation()
        except Exception as error:
            if not retryable(error) or (following := next(waits, None)) is None:
                raise
            if on_retry is not None:
                on_retry(error, *following)
            if following[1] > 0:
                sleep(following[1])
