"""Passbook: bank-statement analytics as DataFrame operators."""
