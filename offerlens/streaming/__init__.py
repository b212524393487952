"""offerlens.streaming"""
