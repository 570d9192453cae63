"""Collections for asyncio: each call runs in a thread, where it waits for Spark without holding up the loop."""

from __future__ import annotations

import asyncio

from pyspark.sql import DataFrame

from starling.sources.collection import Collection


class AsyncCollection:
    """Every method of Collection as a coroutine; results that are DataFrames come as lists of rows."""

    def __init__(self, collection: Collection):
        self.sync = collection

    def __getattr__(self, name: str):
        method = getattr(self.sync, name)
        if not callable(method):
            return method

        def call(*args, **kwargs):
            out = method(*args, **kwargs)
            return out.collect() if isinstance(out, DataFrame) else out

        async def run(*args, **kwargs):
            return await asyncio.to_thread(call, *args, **kwargs)

        return run

    async def __aenter__(self) -> AsyncCollection:
        return self

    async def __aexit__(self, kind, *_) -> None:
        if kind is None:
            await asyncio.to_thread(self.sync.save)
