"""The four clients against a local stand-in for their services."""

import http.server
import json
import sys
import threading
import types

import pytest

from inkspan.sources import recognisers


class Service(http.server.BaseHTTPRequestHandler):
    asked: list = []
    left = 0

    def log_message(self, *args):
        pass

    def _send(self, status, body, **headers):
        self.send_response(status)
        for k, v in headers.items():
            self.send_header(k.replace("_", "-"), v)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def do_POST(self):
        image = self.rfile.read(int(self.headers["Content-Length"]))
        Service.asked.append((self.path, self.headers["Ocp-Apim-Subscription-Key"], self.headers["Content-Type"], image))
        if self.path.endswith("/read/analyze"):
            Service.left = 2
            here = f"http://127.0.0.1:{self.server.server_port}/answer"
            self._send(202, {}, **({} if image == b"lost" else {"Operation_Location": here + ("/bad" if image == b"bad" else "")}))
        elif image == b"bad":
            self._send(200, {"code": "Busy", "message": "later"})
        elif image == b"gone":
            self._send(404, {})
        else:
            self._send(200, {"regions": [{"lines": [{"words": [{"text": "a"}, {"text": "b"}]}, {"words": [{"text": "c"}]}]}]})

    def do_GET(self):
        Service.left -= 1
        if self.path.endswith("bad"):
            self._send(200, {"status": "failed"})
        elif Service.left > 0:
            self._send(200, {"status": "running"})
        else:
            self._send(200, {"status": "succeeded", "analyzeResult": {"version": "3.2.0", "readResults": [{"lines": [{"text": "one"}, {"text": "two"}]}]}})


@pytest.fixture()
def service():
    Service.asked = []
    server = http.server.HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()


def test_azure_text(service):
    client = recognisers.AzureText(service, "secret")
    got = client.run(b"image")
    assert (got["service"], got["version"], got["text"]) == ("Azure", "vision/v3.1/ocr", "a b\nc") and json.loads(got["raw"])["regions"]
    assert Service.asked == [("/vision/v3.1/ocr?language=unk&detectOrientation=false", "secret", "application/octet-stream", b"image")]
    with pytest.raises(RuntimeError, match="Busy later"):
        client.run(b"bad")
    with pytest.raises(Exception, match="404"):
        client.run(b"gone")


def test_azure_reading(service):
    got = recognisers.AzureReading(service, "secret", wait=0.0).run(b"image")
    assert (got["service"], got["version"], got["text"]) == ("AzureRead", "3.2.0", "one\ntwo") and got["milliseconds"] >= 0
    with pytest.raises(RuntimeError, match="failed"):
        recognisers.AzureReading(service, "k", wait=0.0).run(b"bad")
    with pytest.raises(RuntimeError, match="no place"):
        recognisers.AzureReading(service, "k", wait=0.0).run(b"lost")
    with pytest.raises(RuntimeError, match="no answer after 1"):
        recognisers.AzureReading(service, "k", wait=0.0, tries=1).run(b"slow")


def test_aws_text(monkeypatch):
    calls = []

    class Client:
        def detect_document_text(self, Document):  # noqa: N803
            calls.append(Document)
            return {"DetectDocumentTextModelVersion": "1.0", "Blocks": [{"BlockType": "PAGE", "Id": "p"}, {"BlockType": "LINE", "Id": "l", "Text": "x y"}, {"BlockType": "LINE", "Id": "m", "Text": "z"}]}

    boto3, config = types.ModuleType("boto3"), types.ModuleType("botocore.config")
    boto3.client = lambda name, region, config: calls.append((name, region, config)) or Client()
    config.Config = lambda **kw: kw
    for name, module in (("boto3", boto3), ("botocore", types.ModuleType("botocore")), ("botocore.config", config)):
        monkeypatch.setitem(sys.modules, name, module)
    got = recognisers.AwsText("eu-west-1").run(b"image")
    assert calls == [("textract", "eu-west-1", {"retries": {"max_attempts": 3}}), {"Bytes": b"image"}]
    assert (got["service"], got["version"], got["text"], len(json.loads(got["raw"])["Blocks"])) == ("AWS", "1.0", "x y\nz", 3)


def test_gcp_text(monkeypatch):
    class Found:
        text = "seen"

        @staticmethod
        def to_dict(found, preserving_proto_field_name):
            return {"pages": [], "text": found.text, "kept": preserving_proto_field_name}

    answers = [Found(), None]

    class Client:
        @classmethod
        def from_service_account_file(cls, path):
            assert path == "key.json"
            return cls()

        def document_text_detection(self, image):
            assert image == {"content": b"image"}
            return types.SimpleNamespace(full_text_annotation=answers.pop(0))

    vision = types.ModuleType("google.cloud.vision")
    vision.ImageAnnotatorClient, vision.Image = Client, lambda **kw: kw
    cloud, google = types.ModuleType("google.cloud"), types.ModuleType("google")
    cloud.vision, google.cloud = vision, cloud
    for name, module in (("google", google), ("google.cloud", cloud), ("google.cloud.vision", vision)):
        monkeypatch.setitem(sys.modules, name, module)
    first, second = (recognisers.GcpText("key.json").run(b"image") for _ in range(2))
    assert (first["service"], first["version"], first["text"], json.loads(first["raw"])) == ("GCP", "v1", "seen", {"pages": [], "text": "seen", "kept": True})
    assert (second["text"], second["raw"]) == ("", b"{}")
