"""Declarative request objects; each turns into Columns or DataFrame calls."""
