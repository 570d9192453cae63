import asyncio
import json
import threading
import urllib.request

import numpy as np
import pytest

from starling import errors
from starling.sources.aio import AsyncCollection
from starling.sources.collection import Client, Collection
from starling.sources.http import Api, serve


def test_asyncio(spark, tmp_path):
    async def run():
        async with AsyncCollection(Collection.create(spark, f"file://{tmp_path}/a", 2)) as c:
            await c.add_many(["a", "b"], [[1, 0], [0, 1]])
            found = await asyncio.gather(c.search([1, 0], 1), c.search([0, 1], 1), c.count())
            return [found[0][0]["id"], found[1][0]["id"], found[2], c.dim]

    assert asyncio.run(run()) == ["a", "b", 2, 2]


def test_routes(spark, tmp_path):
    api = Api(Client(spark, f"file://{tmp_path}/root"))
    call = lambda method, path, **body: api.handle(method, path, json.dumps(body).encode() if body else b"")
    assert call("POST", "/collections", name="c", dim=2, metric="l2") == (200, {"created": "c"})
    assert call("POST", "/collections", name="c", dim=2)[0] == 400
    assert call("POST", "/collections/c/add", id="a", vector=[1, 0], metadata={"x": 1}) == (200, {"added": "a"})
    assert call("POST", "/collections/c/add_many", ids=["b", "c"], vectors=[[0, 1], [5, 5]]) == (200, {"added": 2})
    assert call("POST", "/collections/c/add_many", ids=["d"], vectors=[])[0] == 400
    assert call("POST", "/collections/c/upsert", id="b", vector=[2, 2]) == (200, {"upserted": "b"})
    assert call("POST", "/collections/c/search", vector=[1, 0], k=1, filter={"x": 1}) == (200, [{"id": "a", "distance": 0.0, "metadata": {"x": 1}}])
    assert call("POST", "/collections/c/search", vector=[1, 0], k=0) == (200, []) and len(call("POST", "/collections/c/search", vector=[1, 0])[1]) == 3
    assert call("GET", "/collections/c/get/a") == (200, {"id": "a", "vector": [1, 0], "metadata": {"x": 1}})
    assert call("GET", "/collections/c/get/zz")[0] == 404 and call("GET", "/collections/no/stats")[0] == 404 and call("GET", "/nowhere")[0] == 404
    assert call("DELETE", "/collections/c/delete/a") == (200, {"deleted": True})
    assert call("POST", "/collections/c/save") == (200, {"saved": "c"})
    assert call("GET", "/collections/c/stats")[1]["num_vectors"] == 2
    server = serve(api.client, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/collections") as r:
        assert json.load(r) == ["c"]
    server.shutdown()
    assert call("DELETE", "/collections/c") == (200, {"deleted": True})


def test_flat(spark, tmp_path):
    c = Collection.create(spark, f"file://{tmp_path}/f", 2)
    c.add_flat(["a", "b"], np.array([1, 2, 3, 4], dtype="float32"))
    assert c.get("b")[0] == [3, 4]
    with pytest.raises(errors.DimensionMismatch):
        c.add_flat(["x"], [1, 2, 3])
