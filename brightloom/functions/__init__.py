"""Scalar building blocks: functions from Columns to a Column."""
