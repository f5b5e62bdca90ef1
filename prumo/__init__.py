"""Tender triage and quotation checking as Spark DataFrame operators."""
