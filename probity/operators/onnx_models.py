"""Models in ONNX files: the adapter that runs them, and export of the built-in network.

Files are read by onnxruntime where it is installed; a session lives once in each Python worker. Export writes the few
message fields that a feed-forward network needs, so no other library is asked for.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np

from probity.operators.models import Network

#: Fixed values of the format: field numbers and types of the messages that are written.
IR_VERSION, OPSET, FLOAT = 8, 13, 1


def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        out.append(n & 127 | (128 if n > 127 else 0))
        n >>= 7
        if not n:
            return bytes(out)


def _number(tag: int, n: int) -> bytes:
    return _varint(tag << 3) + _varint(n)


def _bytes(tag: int, data: bytes | str) -> bytes:
    data = data.encode() if isinstance(data, str) else data
    return _varint(tag << 3 | 2) + _varint(len(data)) + data


def _tensor(name: str, value: np.ndarray) -> bytes:
    dims = b"".join(_number(1, n) for n in value.shape)
    return dims + _number(2, FLOAT) + _bytes(8, name) + _bytes(9, np.ascontiguousarray(value, dtype="<f4").tobytes())


def _value(name: str, width: int) -> bytes:
    shape = _bytes(1, _bytes(2, "n")) + _bytes(1, _number(1, width))
    return _bytes(1, name) + _bytes(2, _bytes(1, _number(1, FLOAT) + _bytes(2, shape)))


def _node(kind: str, inputs: list[str], output: str) -> bytes:
    return b"".join(_bytes(1, i) for i in inputs) + _bytes(2, output) + _bytes(3, output) + _bytes(4, kind)


def export(network: Network) -> bytes:
    """An ONNX file of the network: Gemm and Relu for each layer, Softmax at the end."""
    nodes, tensors, at = [], [], "input"
    for i, (w, b) in enumerate(network.layers):
        tensors += [_tensor(f"w{i}", w), _tensor(f"b{i}", b)]
        last = i == len(network.layers) - 1
        nodes.append(_node("Gemm", [at, f"w{i}", f"b{i}"], f"z{i}"))
        nodes.append(_node("Softmax" if last else "Relu", [f"z{i}"], "probs" if last else f"relu_{i}"))
        at = f"relu_{i}"
    width, classes = network.layers[0][0].shape[0], network.layers[-1][0].shape[1]
    graph = b"".join(_bytes(1, n) for n in nodes) + _bytes(2, "network") + b"".join(_bytes(5, t) for t in tensors) + _bytes(11, _value("input", width)) + _bytes(12, _value("probs", classes))
    return _number(1, IR_VERSION) + _bytes(7, graph) + _bytes(8, _bytes(1, "") + _number(2, OPSET))


@dataclass(frozen=True)
class OnnxModel:
    """Predictions and parameters of an ONNX file; activations aren't available through this adapter."""

    content: bytes
    classes: tuple[str, ...]
    capabilities: dict = field(default_factory=lambda: {"predict": True, "parameters": True, "activations": False})

    def digest(self) -> str:
        return hashlib.sha256(self.content).hexdigest()

    def parameters(self) -> dict[str, np.ndarray]:
        return initializers(self.content)

    def predict(self, x: np.ndarray) -> np.ndarray:
        session = _session(self.content)
        out = session.run(None, {session.get_inputs()[0].name: np.asarray(x, dtype=np.float32)})[0]
        if np.allclose(out.sum(axis=1), 1, atol=1e-3):
            return out
        e = np.exp(out - out.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


_sessions: dict[str, object] = {}


def _session(content: bytes):
    import onnxruntime

    key = hashlib.sha256(content).hexdigest()
    if key not in _sessions:
        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1
        _sessions.clear()
        _sessions[key] = onnxruntime.InferenceSession(content, options, providers=["CPUExecutionProvider"])
    return _sessions[key]


def initializers(content: bytes) -> dict[str, np.ndarray]:
    """The 32-bit float tensors of an ONNX file by name, read from its messages."""
    out = {}
    for field, value in _fields(content):
        if field == 7:
            for kind, tensor in _fields(value):
                if kind == 5:
                    dims, name, raw, floats, dtype = [], "", b"", [], 0
                    for tag, v in _fields(tensor):
                        if tag == 1:
                            dims += [v] if isinstance(v, int) else _packed(v)
                        elif tag == 2:
                            dtype = v
                        elif tag == 4:
                            floats.append(v)
                        elif tag == 8:
                            name = v.decode()
                        elif tag == 9:
                            raw = v
                    if dtype == FLOAT:
                        out[name] = np.frombuffer(raw or b"".join(floats), dtype="<f4").reshape(dims).astype(np.float64)
    return out


def _fields(data: bytes):
    """(field, value) of a message: numbers of varint fields, bytes of all others."""
    at = 0
    while at < len(data):
        key, at = _read_varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _read_varint(data, at)
        else:
            size, at = _read_varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        n |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return n, at


def _packed(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        n, at = _read_varint(data, at)
        out.append(n)
    return out


def available() -> dict[str, bool]:
    """Suffixes of model files and whether their runtime is installed here."""
    import importlib.util

    return {".onnx": importlib.util.find_spec("onnxruntime") is not None, ".pt": False}


def load(path: str, content: bytes, classes: tuple[str, ...]) -> OnnxModel:
    """The adapter for a file by its suffix; formats without one are named in the error."""
    if path.lower().endswith(".onnx"):
        return OnnxModel(content, classes)
    raise ValueError(f"no adapter for {path}: known are .onnx")
