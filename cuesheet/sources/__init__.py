"""Readers and writers of subtitle and lyric formats."""
