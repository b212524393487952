"""offerlens.operators"""
