"""Limits and defaults, in one frozen value that functions take and tasks capture."""

from __future__ import annotations

from dataclasses import dataclass

MB = 1 << 20


@dataclass(frozen=True)
class Settings:
    max_file_bytes: int = 50 * MB
    max_files_per_job: int = 20
    max_job_bytes: int = 200 * MB
    max_archive_bytes: int = 100 * MB
    max_archive_files: int = 200
    max_archive_uncompressed_bytes: int = 500 * MB
    max_archive_ratio: float = 200.0
    ratio_from_bytes: int = 64 * 1024
    max_output_chars: int = 5_000_000
    min_chars_per_page: int = 100
    max_pages: int = 100
    session_minutes: int = 30
    jobs_per_hour: int = 40
    upload_bytes_per_hour: int = 500 * MB
    low_confidence: float = 70.0
    ocr_languages: str = "eng+ben"
    row_timeout_seconds: float = 300.0
