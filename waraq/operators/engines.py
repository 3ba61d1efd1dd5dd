"""Recognisers of page images for :func:`waraq.operators.ingest.recognise`, with an outcome for every image.

A text is a success, an empty one too. None says that the engine is not installed, and a text that starts with [ERR that it
failed on this image. An engine is sent to tasks as it is and opens what it needs there, once a worker.
"""

from __future__ import annotations

import base64
import io
import os
from collections.abc import Callable, Iterable

from waraq.functions.rules import DEFAULT_MODEL, LOCAL_OCR, VISION_OPTIONS, VISION_PROMPT


class LocalOcr:
    """The usual local OCR package, through its Python module. Images are any that the imaging package opens."""

    def __init__(self, languages: str = LOCAL_OCR[0], config: str = LOCAL_OCR[1], command: str | None = None):
        self.languages, self.config, self.command = languages, config, command

    def __call__(self, images: Iterable[bytes | None]) -> list[str | None]:
        images = list(images)
        try:
            import pytesseract
            from PIL import Image
        except ImportError:
            return [None] * len(images)
        if self.command:
            pytesseract.pytesseract.tesseract_cmd = self.command

        def read(image: bytes | None) -> str:
            try:
                return pytesseract.image_to_string(Image.open(io.BytesIO(bytes(image or b""))), lang=self.languages, config=self.config)
            except Exception as error:
                return f"[ERR Tesseract: {error}]"

        return [read(image) for image in images]


class VisionModel:
    """A vision model behind a client with ``generate(model, prompt, images, options, stream)``, which gives a mapping with
    the text under ``response``. ``connect`` makes the client, once a worker. Images go in base64, one a call.

    Threads, where the options do not say, are those of the machine less two, at least two.
    """

    def __init__(self, connect: Callable[[], object], model: str = DEFAULT_MODEL, prompt: str = VISION_PROMPT, options: dict | None = None):
        self.connect, self.model, self.prompt = connect, model, prompt
        self.options = dict(VISION_OPTIONS if options is None else options)
        self._client = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_client": None}

    def __call__(self, images: Iterable[bytes | None]) -> list[str]:
        options = {"num_thread": max(2, (os.cpu_count() or 1) - 2)} | self.options

        def read(image: bytes | None) -> str:
            try:
                if self._client is None:
                    self._client = self.connect()
                answer = self._client.generate(model=self.model, prompt=self.prompt, images=[base64.b64encode(bytes(image or b"")).decode()], options=options, stream=False)
                return answer.get("response") or ""
            except Exception as error:
                return f"[ERR Vision: {error}]"

        return [read(image) for image in images]
